"""Statistics over a table of scores that grows, without reading its rows again.

An append leaves the counts of its distinct values. Counts add up, and count, mean, deviation
and the exact quartiles all follow from them, so a description reads counts only: at most one
row per distinct value and append, and one per distinct value after ``merge``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageloom.operators.stats import describe_counts, value_counts
from passageloom.sources.versions import Versions

_EMPTY = {"parts": [], "batches": []}


@dataclass(frozen=True)
class ScoreStore:
    """Value counts below ``path`` of the columns ``cols`` (string group columns ``by``)."""

    path: str
    cols: tuple[str, ...]
    by: tuple[str, ...] = ()

    def _state(self, spark: SparkSession) -> dict:
        return Versions(spark, self.path).current(_EMPTY)[1]

    def _write(self, counts: DataFrame) -> str:
        folder = f"counts-{uuid.uuid4().hex}"
        counts.write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, scores: DataFrame, batch: int) -> None:
        """Count the rows of ``scores`` in; a ``batch`` that has been counted already is left alone."""
        spark = scores.sparkSession
        if batch in self._state(spark)["batches"]:
            return
        folder = self._write(value_counts(scores, list(self.cols), self.by))

        def listed(state: dict) -> dict:
            if batch in state["batches"]:
                return state
            return {"parts": [*state["parts"], folder], "batches": sorted([*state["batches"], batch])}

        Versions(spark, self.path).update(_EMPTY, listed)

    def counts(self, spark: SparkSession) -> DataFrame:
        """``(by, metric, v, n)`` over all appends."""
        return self._summed(spark, self._state(spark)["parts"])

    def _summed(self, spark: SparkSession, parts: list[str]) -> DataFrame:
        fields = [T.StructField(c, T.StringType()) for c in (*self.by, "metric")]
        schema = T.StructType([*fields, T.StructField("v", T.DoubleType()), T.StructField("n", T.LongType())])
        if not parts:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts))
        return rows.groupBy(*self.by, "metric", "v").agg(F.sum("n").alias("n"))

    def describe(self, spark: SparkSession) -> DataFrame:
        """``describe_scores`` of all rows appended so far."""
        return describe_counts(self.counts(spark), self.by)

    def merge(self, spark: SparkSession) -> None:
        """Add the counts of all appends up into one part. Appends that are listed meanwhile stay parts."""
        old = self._state(spark)["parts"]
        if len(old) < 2:
            return
        folder = self._write(self._summed(spark, old))

        def listed(state: dict) -> dict:
            if not set(old) <= set(state["parts"]):
                raise RuntimeError("another merge has been listed")
            return {**state, "parts": [folder, *(p for p in state["parts"] if p not in old)]}

        Versions(spark, self.path).update(_EMPTY, listed)
