from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from passageloom.llm import mixing


def filled(sizes, weights):
    """Targets by repeated sharing of what is over the caps."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / open_ > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        full |= over


def test_targets_and_words(docs, rows):
    out = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    targets = filled(sizes, mixing.WEIGHTS)
    assert len(out) == len(rows)
    assert {round(r.target, 6) for r in out} == {round(t, 6) for t in targets.values()}
    assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in out)
    largest = max(r.size for r in out)
    total = sum(r.taken for r in out)
    assert sum(sizes.values()) - largest * len(sizes) <= total <= sum(sizes.values())
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_window_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(mixing, "SUPER_BUCKETS", 4)
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    fine = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10**6)
    assert fine == sorted(map(str, mixing.mix(docs).collect()))


def test_documents_as_often_as_taken(docs, nothing):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = F.size(F.filter(F.split("text", "[ \t\n\x0b\f\r]+"), lambda w: w != ""))
    mixed = sum(r[0] for r in out.select(words).collect())
    assert mixed == sum(r.taken for r in mixing.mix(docs).collect())
    assert mixing.mixed_documents(nothing).collect() == []


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2


def test_plan_is_native(docs, plan):
    assert not any(word in plan(mixing.mix(docs)) for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("source", ["only"])
def test_one_source_takes_everything_once(spark, source):
    docs = spark.createDataFrame([(i, "a b c", source) for i in range(20)], "doc_id long, text string, source string")
    assert {(r.size, r.taken) for r in mixing.mix(docs).collect()} == {(3, 3)}


def test_ten_and_more_copies(spark):
    small, large = [(i, "a b", "a") for i in range(6)], [(100 + i, "c d e", "b") for i in range(60)]
    docs = spark.createDataFrame(small + large, "doc_id long, text string, source string").coalesce(1)
    out = Counter(r.doc_id for r in mixing.mixed_documents(docs, weights=(50, 1), max_epochs=12).collect())
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(docs, weights=(50, 1), max_epochs=12).collect() if r.taken}
    assert max(want.values()) == 12 and out == want
