import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from passageloom.llm import suffix_dedup


def brute(rows, length):
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, p", [(400, 17), (40, 5), (20, 3)])
def test_equals_brute_force(docs, rows, length, p):
    out = suffix_dedup.remove_repeats(docs, length=length, p=p).collect()
    # The long text is compared too, in short windows only where that is quick.
    assert sorted((tuple(r) for r in out), key=str) == brute([r[:2] for r in rows], length)


def test_strings_that_overlap_and_touch(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdé") for _ in range(60)) for _ in range(2))
    rows = [(1, a + b), (2, "xx" + a + "yy" + b), (3, b + a), (4, "z" * 100), (5, a[:30]), (6, a[1:41] + "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, length=40, p=5, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(rows, 40)
    for r in out:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("p", [2, 3, 5, 7, 17])
def test_cover_has_every_difference(p):
    period, residues = suffix_dedup.difference_cover(p)
    assert len({(int(a) - int(b)) % period for a in residues for b in residues}) == period


def test_hashes_across_segments(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    at = np.sort(np.random.default_rng(2).choice(4900, 700, replace=False))
    whole = suffix_dedup.window_hashes(data, at, 50)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 64)
    assert (suffix_dedup.window_hashes(data, at, 50) == whole).all()
    assert len(np.unique(whole)) == len(at)
