"""Descriptions of a growing table of scores."""

import math
import random

from passageloom.operators.stats import describe_scores
from passageloom.sources.score_store import ScoreStore

SCHEMA = "kind string, a double, b double"


def described(df):
    return {
        (r.kind, r.metric): tuple(None if r[c] is None else round(r[c], 9) for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max"))
        for r in df.collect()
    }


def test_every_append_is_described_exactly(spark, tmp_path):
    rng, rows = random.Random(1), []
    store = ScoreStore(str(tmp_path / "scores"), ("a", "b"), ("kind",))
    assert store.describe(spark).collect() == []
    for batch in range(3):
        new = [(rng.choice(["x", "y", None]), rng.choice([1.5, 2.0, rng.random(), None, math.nan]), float(rng.randint(0, 3))) for _ in range(40)]
        if batch == 1:
            new += [("only nulls", None, None)]
        rows += new
        frame = spark.createDataFrame(new, SCHEMA)
        store.append(frame, batch)
        store.append(frame, batch)  # a retry
        whole = described(describe_scores(spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["kind"]))
        assert described(store.describe(spark)) == whole
        if batch == 1:
            store.merge(spark)
            assert described(store.describe(spark)) == whole
    assert all("/counts-" in f for f in store.counts(spark).inputFiles()) and store.counts(spark).count() < 2 * len(rows)
