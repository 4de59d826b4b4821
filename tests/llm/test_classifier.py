import math
import random
import re

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageloom.llm import classifier
from passageloom.llm.classifier import Settings

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


def made(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = ["".join(rng.choice(["the", "on", "er"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        text = " | ".join(w + rng.choice(["***", "&&&", ""]) for w in words) if bad else " ".join(words) + "."
        yield i, text, 0 if bad else 1


def test_held_out_accuracy(spark):
    rows = list(made(400, 1))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3], "doc_id long, quality int")
    out = {r.doc_id: r for r in classifier.classify(docs, labels).collect()}
    unseen = [(i, q) for i, _, q in rows if not i % 3]
    assert sum(out[i].predicted == q for i, q in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= classifier.THRESHOLD) for r in out.values())
    kept = {r.doc_id for r in classifier.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in out.items() if r.predicted}


def test_awkward_rows_and_labels(spark, docs, rows):
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 7), (5, 0), (5, 1)], "doc_id long, quality int")
    out = classifier.classify(docs, labels).collect()
    assert len(out) == len(rows)
    blank = {r.score for r in out if r.doc_id in (0, 1, 2)}
    assert len(blank) == 1
    none = classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_same_result_again_and_bounded_sample(spark):
    rows = list(made(200, 2))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    small = Settings(sample=50)
    runs = []
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], SCHEMA).repartition(parts)
        runs.append(sorted((r.doc_id, round(r.score, 9)) for r in classifier.classify(docs, labels, settings=small).collect()))
    assert runs[0] == runs[1]


def test_dot_product_equals_sparse_features():
    import numpy as np

    features = classifier.Features(10)
    weights = np.random.default_rng(1).normal(size=1 << 10)
    for text in ("", "one", "one two two !! TWO", "a b " * 50):
        where, values = features.sparse(text)
        assert abs(weights[where] @ values - features.dot(text, weights)) < 1e-9


MASK = (1 << 64) - 1


def plain_features(text, bits):
    """``{index: value}`` by loops over tokens, with whole numbers instead of arrays."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)

    def kind(t):
        if not t[0].isalnum():
            return t[:4]
        return "0" if t.isdigit() else "A" if t.isupper() and len(t) > 1 else "a"

    words = [xxhash.xxh64_intdigest(t.lower().encode()) for t in tokens]
    kinds = [xxhash.xxh64_intdigest(kind(t).encode(), seed=1) for t in tokens]
    odd = 0x9E3779B97F4A7C15
    families = [words, kinds]
    if len(tokens) > 1:
        families.append([(a * odd + b) & MASK for a, b in zip(words, words[1:])])
        families.append([(a * odd + b + (w == v)) & MASK for a, b, w, v in zip(kinds, kinds[1:], words, words[1:])])
    out = {}
    for number, family in enumerate(families if tokens else []):
        for h in family:
            mixed = ((h + number) * 0xD6E8FEB86659FD93) & MASK
            i = (mixed ^ (mixed >> 32)) & ((1 << bits) - 1)
            out[i] = out.get(i, 0.0) + 1 / len(family)
    return out


def plain_scores(rows, s):
    """Follow-the-regularised-leader in plain loops; ``rows`` are ``(id, text, label or None, key, shard)``."""

    def weight(z, n):
        return 0.0 if abs(z) <= s.l1 else -(z - math.copysign(s.l1, z)) / ((s.beta + math.sqrt(n)) / s.alpha + s.l2)

    state = {}
    for _ in range(s.rounds):
        merged = {}
        for shard in sorted({r[4] for r in rows if r[2] is not None}):
            own = dict(state)
            for _, text, label, _, _ in sorted((r for r in rows if r[4] == shard and r[2] is not None), key=lambda r: (r[3], r[2])):
                x = plain_features(text, s.bits) | {"bias": 1.0}
                w = {i: weight(*own.get(i, (0.0, 0.0))) for i in x}
                p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
                for i, v in x.items():
                    z, n = own.get(i, (0.0, 0.0))
                    g = (p - label) * v
                    own[i] = z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / s.alpha * w[i], n + g * g
            for i, zn in own.items():
                merged.setdefault(i, []).append(zn)
        state = {i: (sum(z for z, _ in zs) / len(zs), sum(n for _, n in zs) / len(zs)) for i, zs in merged.items()}
    w = {i: weight(*zn) for i, zn in state.items()}
    return {i: 1 / (1 + math.exp(-w.get("bias", 0.0) - sum(w.get(k, 0.0) * v for k, v in plain_features(t, s.bits).items()))) for i, t, *_ in rows}


def test_scores_equal_plain_loops(spark):
    s = Settings(shards=3, rounds=3, bits=10)
    rows = list(made(60, 4)) + [(900, "", 1), (901, "One ONE 1 !!??!", 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3], "doc_id long, quality int")
    keys = {r.doc_id: (r.key, r.key % 3) for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    want = plain_scores([(i, t, q if i % 3 else None, *keys[i]) for i, t, q in rows], s)
    got = {r.doc_id: r.score for r in classifier.classify(docs, labels, settings=s).collect()}
    assert len(set(round(v, 3) for v in want.values())) > 20
    assert all(math.isclose(got[i], want[i], abs_tol=1e-5) for i in want)
