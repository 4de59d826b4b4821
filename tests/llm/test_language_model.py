import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passageloom.llm import language_model
from passageloom.llm.blocks import each_block, store_blocks
from passageloom.llm.common import held_out
from passageloom.llm.exchange import pack
from passageloom.llm.language_model import EliasFano, Settings, Trie


def learn(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 != 2


def test_scores_equal_brute_force(docs, rows):
    out = language_model.score_documents(docs, ~held_out(F.col("doc_id"), 7)).collect()
    tokens = [((r[1] or "").encode().lower().split() + [None], learn(r[0])) for r in rows]
    one, two, texts = Counter(), Counter(), 0
    for words, use in tokens:
        if use:
            one.update(words)
            two.update(zip(["start", *words], words))
            texts += 1
    total, distinct, s = sum(one.values()), len(one), Settings()
    want = []
    for (words, _), row in zip(tokens, rows):
        base = [(one[w] + 1) / (total + distinct + 1) for w in words]
        full = []
        for left, w, p in zip(["start", *words], words, base):
            context = texts if left == "start" else one[left]
            ratio = min(1, max(0, two[left, w] - s.discount) / max(context, 1))
            full.append(s.mix * ratio + (1 - s.mix) * p if context else p)
        want.append((row[0], len(words), sum(one[w] > 0 for w in words), sum(map(math.log10, base)), sum(map(math.log10, full))))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in out), key=str)
    want = sorted(want, key=str)
    assert {r.train_tokens for r in out} == {total}
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3])
        # The step of the quantiser bounds what a token's score can be off.
        assert abs(g[4] - w[4]) <= language_model.quantiser(total, s) * g[1]


def test_no_training_rows(docs):
    out = language_model.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0 for r in out)


@pytest.mark.parametrize("n, universe", [(1, 1), (1, 1 << 32), (1000, 1200), (5000, 1 << 40), (3000, 1 << 20)])
def test_successor_search(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    sequence = EliasFano.build(values, universe)
    asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
    at, found = sequence.find(asked)
    assert (at == np.searchsorted(values, asked)).all() and (found == np.isin(asked, values)).all()
    assert (sequence.values(np.arange(len(values))) == values).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique((rng.integers(0, 300, 5000, dtype=np.uint64) << np.uint64(32)) | rng.integers(0, 900, 5000, dtype=np.uint64))
    codes = rng.integers(0, 200, len(keys)).astype(np.uint8)
    with open(tmp_path / "levels", "w+b") as file:
        trie = Trie.build(keys, codes).mapped(file)
        asked = np.unique(np.concatenate([keys, keys + np.uint64(1), np.arange(0, 400, dtype=np.uint64) << np.uint64(32)]))
        known = dict(zip(keys.tolist(), codes.tolist()))
        assert trie.look_up(asked).tolist() == [known.get(k, 255) for k in asked.tolist()]


def test_totals_over_32_bits():
    keys = np.array([3, 8], np.uint64)
    block = np.array([1, 3 * 10**9], np.uint32).tobytes()
    pdf = pd.DataFrame({"owner": [0, 0], "keys": [pack(keys, 0)] * 2, "counts": [block] * 2})
    replies = language_model._word_counts(*language_model._merged(pdf, 1))
    for reply in replies:
        assert language_model._joined([{"reply": reply}], language_model._TOTAL).tolist() == [2, 6 * 10**9]


def test_blocks_lie_in_short_files(spark):
    """A reader holds thousands of rows of a file at once; a part has as many blocks as its split has text."""
    docs = spark.createDataFrame([(i, "word " * 30, False) for i in range(90)], "doc_id long, text string, flag boolean").coalesce(1)
    blocks = store_blocks(docs, "short", block_chars=200)
    per_file = blocks.groupBy(F.input_file_name()).count().collect()
    assert blocks.count() == 90 and max(r["count"] for r in per_file) <= 16
    assert blocks.select("part").distinct().count() == 1


def test_a_batch_is_read_block_by_block():
    batch = pa.RecordBatch.from_pydict({"block": [1, 2, 3], "texts": [["a"], [], ["b", "c"]]})
    assert list(each_block(iter([batch, batch.slice(0, 0), batch.slice(1)]))) == batch.to_pylist() + batch.to_pylist()[1:]
