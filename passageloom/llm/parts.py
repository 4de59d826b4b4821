"""Rows stored as they lie in their partitions, so that answers can come to them later."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageloom.session import scratch_path

_ROW_BITS = 33  # monotonically_increasing_id keeps the row inside its partition here


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``part``, the partition a row lies in, and ``pos``, its place there."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return df.withColumns({"part": F.spark_partition_id(), "pos": row})


def part_buckets(spark: SparkSession) -> int:
    """Over how many buckets stored parts are dealt."""
    return min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)


@contextmanager
def placed_by_part(spark: SparkSession) -> Iterator[None]:
    """Lets a join on ``(part, pos)`` that is planned here use rows that are placed by ``part`` alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store_parts(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder, bucketed by its column ``part``, and read it back.

    Nothing is shuffled: the rows of a part come from one task and make one
    file, or a file for each ``file_rows`` of them: a reader holds thousands of
    rows of a file at once, so large rows need short files. Later joins and groupings by
    ``part`` move only the other side, so a text never crosses the network to meet a few bytes about it.
    """
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd")
        .option("maxRecordsPerFile", file_rows).bucketBy(part_buckets(spark), "part").saveAsTable(table)
    )
    return spark.table(table)


def store_documents(docs: DataFrame, id_col: str, text_col: str, name: str, source_col: str | None = None) -> DataFrame:
    """``part, pos, doc_id, text, _row`` with the whole row of ``docs`` but its text in ``_row``.

    ``unpack_documents`` gives the columns of ``docs`` back.
    """
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if source_col:
        columns.append(F.col(source_col).alias("source"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return store_parts(numbered(docs.select(*columns, F.struct(*others).alias("_row"))), name)


def unpack_documents(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` in their order from ``text`` and ``_row``."""
    return rows.select(*(F.col("text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def bring_digits(rows: DataFrame, digits: DataFrame, name: str, width: int = 1) -> DataFrame:
    """``rows`` with the ``digit`` of ``width`` characters that ``digits`` (``part, pos, digit``) has for each of them.

    A part's digits become one string, ``width`` times as long as the part has rows,
    and a row picks its own by its place; the rows themselves stay where they are.
    """
    lists = digits.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("pos", "digit"))).alias("_list"))
    strings = lists.select("part", F.array_join(F.transform("_list", lambda x: x["digit"]), "").alias("_digits"))
    picked = F.substring("_digits", (F.col("pos") * width + 1).cast("int"), F.lit(width))
    return rows.join(strings, "part").withColumn(name, picked).drop("_digits")
