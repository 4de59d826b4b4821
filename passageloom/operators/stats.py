"""Summary statistics and grouped sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageloom.operators.ordering import running_total

# The quartiles of a description and their column names.
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe_scores(df: DataFrame, cols: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per group and column: count, mean, std, min, quartiles, max.

    Quartiles are exact, with linear interpolation. Values are counted before
    the shuffle, then ranked by a running total over range partitions, so a
    group of any size is spread over all tasks. NULL and NaN are left out.
    """
    return describe_counts(value_counts(df, cols, by), by)


def value_counts(df: DataFrame, cols: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``(by, metric, v, n)``: how often each value of each column occurs in each group.

    A NULL value has count 0: it keeps its group. Counts of parts of a table add up to those of the table.
    """
    melted = df.select(
        *by,
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("e"),
    ).select(*by, "e.metric", F.nanvl("e.v", F.lit(None)).alias("v"))
    return melted.groupBy(*by, "metric", "v").agg(F.count("v").alias("n"))


def describe_counts(counted: DataFrame, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``describe_scores`` from value counts."""
    keys = [*by, "metric"]
    ranked = running_total(counted, keys, ["v"], "n", "before")
    totals = ranked.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("avg"),
    )
    rows = ranked.alias("r").join(totals.alias("t"), _same(keys))
    spread = F.sum(F.col("r.n") * F.pow(F.col("r.v") - F.col("t.avg"), 2))
    total = F.first("t.total")
    result = rows.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(
        total.alias("count"),
        F.first("t.avg").alias("mean"),
        F.when(total > 1, F.sqrt(spread / (total - 1))).alias("std"),
        F.min("r.v").alias("min"),
        *[_quantile(p).alias(name) for name, p in QUARTILES.items()],
        F.max("r.v").alias("max"),
    )
    return result


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])


def _quantile(p: float) -> Column:
    """Value at share ``p`` of the sorted values, between its two neighbours."""
    place = p * (F.col("t.total") - 1)

    def at(rank: Column) -> Column:
        held = (F.col("r.before") <= rank) & (rank < F.col("r.before") + F.col("r.n"))
        return F.max(F.when(held, F.col("r.v")))

    low, high = at(F.floor(place)), at(F.ceil(place))
    share = F.first(place - F.floor(place))
    return low + (high - low) * share


def grouped_sum(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums per combination of ``keys`` with a subtotal per level.

    ``level`` is the grouping id: 0 for a full group, so a subtotal differs
    from a group whose key is NULL.
    """
    return df.rollup(*keys).agg(F.grouping_id().alias("level"), *[F.sum(v).alias(f"sum_{v}") for v in values])


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)
