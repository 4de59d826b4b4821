"""Placement of rows, and a join that stays balanced when one key holds a large share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    ways: int = 16,
) -> DataFrame:
    """Join ``many`` to ``one``, the side with far fewer rows per key.

    Each key of ``many`` is spread over ``ways`` partitions by a hash of
    ``spread_by``, and ``one`` is repeated once per partition. Both sides keep
    an exchange of their own directly below the join, so the runtime skew-join
    rule can split a partition further. The repeated side is never broadcast: the optimizer
    takes its size for that of the compressed file that ``one`` may lie in, before the repetition.
    """
    salted = many.withColumn("_way", F.pmod(F.xxhash64(*spread_by), F.lit(ways)))
    repeated = one.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return salted.join(repeated.hint("merge"), [*on, "_way"], how).drop("_way")


def place(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows on unique ``keys`` into ``spark.sql.shuffle.partitions`` partitions.

    The number is explicit because the rows are about to be expanded: chosen at
    run time from their size before it, it would leave most cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
