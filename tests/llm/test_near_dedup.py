import random
import tracemalloc

import numpy as np
from pyspark.sql import types as T

from passageloom.llm import near_dedup
from passageloom.llm.components import components
from passageloom.llm.exchange import pack, unpack
from passageloom.llm.near_dedup import Settings
from passageloom.llm.words import _STEPS, ngrams


def brute(rows, percent):
    """Components by comparing every pair of shingle sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def test_awkward_rows(docs, rows):
    out = near_dedup.group_near_copies(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute([r[:2] for r in rows], 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_groups_larger_than_a_tile(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    out = near_dedup.group_near_copies(df, settings=Settings(tile=16)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows, 80)


def test_keys_meet_whenever_signatures_are_near():
    rng = np.random.default_rng(2)
    settings = Settings()
    for _ in range(50):
        a = rng.integers(0, 1 << 16, settings.positions).astype(np.uint16)
        b = a.copy()
        wrong = rng.choice(settings.positions, settings.distance, replace=False)
        b[wrong] ^= np.uint16(1)
        keys = near_dedup.masked_keys(np.stack([a, b]), settings)
        assert (keys[0] == keys[1]).any()


def test_documents_that_stay(docs, nothing):
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    wanted = {r.doc_id for r in near_dedup.group_near_copies(docs).collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == wanted
    assert near_dedup.drop_near_copies(nothing).collect() == []


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_shingles_that_differ_in_their_last_bits_only():
    values = np.array([1 << 63, (1 << 63) + 1, (1 << 63) + (1 << 15)], np.uint64)
    # The words whose one-word shingles have these hashes: ``mix`` and the step undone.
    h = values ^ (values >> np.uint64(32))
    h = h * np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))
    h = h * np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    h = h ^ (h >> np.uint64(32))
    words = (h - np.uint64(1)) * np.uint64(pow(int(_STEPS[0]), -1, 1 << 64))
    assert ngrams(words, 1).tolist() == values.tolist()
    own = near_dedup.shingles(words, 1)
    assert len(own) == 3
    assert unpack(pack(own, 0), 0).tolist() == values.tolist()


def _near_sets(n, size, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
    sets = []
    for _ in range(n):
        own = base.copy()
        changed = rng.integers(0, size, rng.integers(0, size // 5))
        own[changed] = rng.integers(0, 1 << 64, len(changed), dtype=np.uint64)
        sets.append(np.unique(own))
    return [int(x) for x in rng.permutation(n)], sets


def test_a_tile_takes_few_bytes_for_a_pair():
    nodes, sets = _near_sets(2400, 30, 1)
    tracemalloc.start()
    stars = near_dedup.confirmed(nodes, sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stars
    assert peak < 20 * len(sets) ** 2


def test_a_tile_by_ranges_and_rows(monkeypatch):
    for seed in range(4):
        nodes, sets = _near_sets(70, 60, seed)
        sets[3], sets[4] = np.array([0], np.uint64), np.array([0, (1 << 64) - 1], np.uint64)
        sets[5] = np.array([(1 << 64) - 1], np.uint64)
        linked = {(a, b) for a in range(70) for b in range(70)
                  if a != b and 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 60 * (len(sets[a]) + len(sets[b]) - both)}
        wanted = []
        waiting = set(range(70))
        for first in sorted(waiting, key=lambda x: nodes[x]):
            queue = [first] if first in waiting else []
            waiting.discard(first)
            while queue:
                at = queue.pop()
                found = {b for b in waiting if (at, b) in linked}
                waiting -= found
                queue += found
                wanted += [(nodes[b], nodes[first]) for b in found]
        for size, cells, rows in [(1 << 20, 1 << 22, 256), (50, 300, 7), (1000, 70, 1)]:
            with monkeypatch.context() as patch:
                for name, value in (("_RANGE", size), ("_CELLS", cells), ("_ROWS", rows)):
                    patch.setattr(near_dedup, name, value, raising=False)
                assert sorted(near_dedup.confirmed(nodes, sets, 60)) == sorted(wanted)
