from collections import defaultdict
from hashlib import sha256

from passageloom.llm import exact_dedup
from passageloom.llm.exchange import lowest, owner_of, pack, split, unpack


def test_groups_and_rows_that_stay(docs, rows):
    out = exact_dedup.deduplicate(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    by_hash = {sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(out) == len(rows)
    for r in out:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for digest in by_hash:
        assert sum(r.kept for r in out if r.text_sha256 == digest) == 1


def test_distinct_documents_keep_their_columns(docs, rows):
    out = exact_dedup.distinct_documents(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(r.text for r in kept) == sorted({r[1] or "" for r in rows})
    by_id = {r[0]: r for r in rows if r[0] is not None}
    for r in kept:
        assert tuple(r)[2:] == by_id[r.doc_id][2:]


def test_nothing(nothing):
    assert exact_dedup.deduplicate(nothing).collect() == []
    assert exact_dedup.distinct_documents(nothing).collect() == []


def test_codes_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        for top in (10**6, 2**64 - 1):
            values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            for owners in (1, 3, 17):
                parts = [(o, values[a:b]) for o, a, b in split(values, owners)]
                assert sum(len(v) for _, v in parts) == len(values)
                for o, v in parts:
                    assert (owner_of(v, owners) == o).all() and v[0] >= lowest(o, owners)
                    assert (unpack(pack(v, lowest(o, owners)), lowest(o, owners)) == v).all()
    dense = np.arange(5000, dtype=np.uint64)
    assert (unpack(pack(dense, 0), 0) == dense).all()
