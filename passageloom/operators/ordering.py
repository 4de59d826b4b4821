"""Row numbers and running totals over a whole table, without a one-task window.

Rows are range-partitioned and sorted, then written with their partition
number. The table of partition totals is tiny, so offsets come from it, and
every row adds its own offset. Equal sort keys are never split unevenly
because callers order by a unique key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passageloom.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row inside the partition here


def _sliced(df: DataFrame, order: list[str], name: str) -> DataFrame:
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ordered.withColumn("_pos", F.monotonically_increasing_id()), name)
    return stored.withColumn("_slice", F.shiftright("_pos", _ROW_BITS))


def number_rows(df: DataFrame, order: list[str], name: str = "id", start: int | Callable[[int], int] = 1) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of the unique columns ``order``.

    ``start`` may be a function of the number of rows, which is called once.
    """
    rows = _sliced(df, order, "numbered")
    sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    if callable(start):
        # A number per range partition: at most spark.sql.shuffle.partitions.
        known = sizes.collect()
        start = start(sum(row["_n"] for row in known))
        sizes = df.sparkSession.createDataFrame(known, sizes.schema)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: at most spark.sql.shuffle.partitions rows.
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        rows.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + row + F.lit(start))
        .drop("_slice", "_pos", "_offset")
    )


def running_total(df: DataFrame, by: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same group, per row.

    ``by + order`` must be unique. A group of any size spans as many slices as
    it needs; a window only ever sees one slice.
    """
    rows = _sliced(df, [*by, *order], "running")
    totals = rows.groupBy(*by, "_slice").agg(F.sum(weight).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy("_slice", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Null-safe: a NULL group is a group.
    rows, offsets = rows.alias("r"), offsets.alias("o")
    same = F.col("r._slice") == F.col("o._slice")
    for column in by:
        same = same & F.col(f"r.{column}").eqNullSafe(F.col(f"o.{column}"))
    return (
        rows.join(offsets, same)
        .select("r.*", "_offset")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_slice", "_pos", "_offset")
    )
