"""File listings, tables and evaluation sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passageloom import schemas
from passageloom.functions.text import LOG_SOURCE_ZONE, LOG_TARGET_ZONE
from passageloom.operators.activity import activity_rows
from passageloom.sources.versions import Versions


def list_sources(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file below ``path``; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = path.rstrip("/") + "/"
    files = reader.load(path).select("path", "modificationTime", "length")
    return files.select(
        F.substring_index("path", root, -1).alias("relative_path"), "path", "modificationTime", "length"
    )


def filter_extension(df: DataFrame, ext: str = ".pdf", col: str = "relative_path") -> DataFrame:
    """Rows whose name ends with ``ext``, ignoring case."""
    return df.filter(F.lower(col).endswith(ext.lower()))


def latest_per_path(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The newest row of each path: a later upload replaces an earlier one.

    The rank limit is applied before the shuffle as well as after it, so a path
    with very many versions sends one row per input partition.
    """
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in version])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def source_changes(
    before: DataFrame, after: DataFrame, key: str = "relative_path", version: tuple[str, ...] = ("modificationTime", "length")
) -> DataFrame:
    """``(key, change)`` of two listings with one row per path: what was added, changed or is gone.

    A path whose ``version`` columns are the same in both has no row.
    """
    old = before.select(key, F.struct(*version).alias("_old"))
    new = after.select(key, F.struct(*version).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return old.join(new, key, "full").select(key, change.alias("change")).filter("change is not null")


def read_pairs(
    spark: SparkSession, path: str, ref_col: str, cand_col: str, key: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """An evaluation sheet as ``(reference, candidate)``, with ``pair_id`` first if the sheet has a ``key`` column.

    Columns are found by name, in any order and among others; a missing one fails.
    A CSV sheet may have line breaks in its cells, so each file is one task: keep
    large sheets in Parquet.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    sheet = reader.load(path)
    wanted = {"pair_id": key, "reference": ref_col, "candidate": cand_col}
    missing = sorted(c for c in wanted.values() if c is not None and c not in sheet.columns)
    if missing:
        raise ValueError(f"the sheet at {path} lacks {', '.join(missing)}")
    return sheet.select(*(F.col(f"`{c}`").cast("string").alias(name) for name, c in wanted.items() if c is not None))


def write_chunks(df: DataFrame, path: str | None = None, table: str | None = None, keep: int = 2) -> None:
    """Create or replace the chunk table, stored by language so filters on it skip files.

    At a ``path``, the new rows are written beside the old ones and become the table in one step. A
    reader that opened an older version goes on reading it; the last ``keep`` stay.
    """
    writer = df.write.format("parquet").partitionBy("language")
    if table:
        writer.mode("overwrite").saveAsTable(table)
    elif path:
        spark, folder = df.sparkSession, f"version-{uuid.uuid4().hex}"
        writer.save(f"{path}/{folder}")
        versions = Versions(spark, path)
        versions.update({}, lambda _: {"folder": folder})
        held = {versions.read(n)["folder"] for n in versions.numbers()[-keep:]}
        replaced = {versions.read(n)["folder"] for n in versions.numbers()} - held
        for old in replaced:
            _delete(spark, f"{path}/{old}")
    else:
        raise ValueError("give a path or a table")


def read_chunks(spark: SparkSession, path: str | None = None, table: str | None = None) -> DataFrame:
    """Full scan of the chunk table, as it is now."""
    if table:
        return spark.table(table)
    _, state = Versions(spark, path).current({})
    if not state:
        raise ValueError(f"no chunk table at {path}")
    return spark.read.schema(schemas.CHUNKS).parquet(f"{path}/{state['folder']}")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def reserve_ids(spark: SparkSession, path: str, count: int, stream: str | None = None, batch: int = 0) -> int:
    """The first of ``count`` ids of the log at ``path`` that nobody else gets, larger than all before.

    Any number of writers may ask at once. The newest batch of a ``stream`` that asks again gets the same ids.
    """
    start = 0

    def taken(state: dict) -> dict:
        nonlocal start
        known = state["streams"].get(stream)
        if known and known[0] == batch:
            start = known[1]
            return state
        start = state["next"]
        streams = {**state["streams"], stream: [batch, start]} if stream else state["streams"]
        return {"next": start + count, "streams": streams}

    Versions(spark, f"{path}.ids").update({"next": 1, "streams": {}}, taken)
    return start


def append_activity(pairs: DataFrame, path: str, src: str = LOG_SOURCE_ZONE, dst: str = LOG_TARGET_ZONE) -> None:
    """Append ``(conv_id, turn, question, answer, ts)`` to the activity log, with ids that go on from its last.

    Existing rows are never replaced. Writers may append at the same time: each has ids and a folder of its own.
    """
    spark, starts = pairs.sparkSession, []

    def start(count: int) -> int:
        starts.append(reserve_ids(spark, path, count) if count else 0)
        return starts[0]

    rows = activity_rows(pairs, src, dst, start).select(*schemas.ACTIVITY.fieldNames())
    if starts[0]:
        rows.write.parquet(f"{path}/batch={-starts[0]}")


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of the activity log; empty before the first append."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.ACTIVITY)
    return spark.read.schema(schemas.ACTIVITY).parquet(path).select(*schemas.ACTIVITY.fieldNames())
