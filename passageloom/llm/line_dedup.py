"""Line deduplication against levelled sorted runs of line hashes, in DataFrame operations only.

A ``LineRuns`` store holds the hashes of all lines seen so far in sorted runs: tables
bucketed and sorted by hash, so that a new batch meets them in merge joins without moving
them. A batch's hashes are anti-joined to every run; what is left is new and becomes a run
of level 0. ``fan_in`` runs of a level are merged into one of the next, so that a store
that has seen ``n`` batches has about ``fan_in * log(n)`` runs and a hash is rewritten
``log(n)`` times. Runs are disjoint: a merge is a concatenation in sorted order.

A hash is half of a SHA-256, 128 bits: lines with equal hashes count as equal, which
two different lines among 10**13 would be with a probability of 10**-13.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageloom.llm.common import WHITE
from passageloom.llm.parts import numbered, part_buckets, placed_by_part
from passageloom.session import materialize, scratch_path
from passageloom.sources.versions import Versions

MIN_CHARS = 10
BATCHES = 4
FAN_IN = 2

_RUN = "h binary, holder bigint"
_NULL_ID = -(1 << 63)
_PLACE_BITS = 31  # a text has fewer lines than this has values


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: ends stripped of ASCII white space, A-Z lower-cased."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


class LineRuns:
    """The store at ``path``: a folder per run and numbered versions of the list of runs.

    A run is listed only when it and the batch's result are complete, so a crash leaves the
    store as it was and the batch can be added again. The hashes are dealt over ``buckets`` for
    the life of the store; by default, as many as the session has shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN, buckets: int | None = None):
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.versions = Versions(spark, path)
        state = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}
        self.number, state = self.versions.current(state)
        self.buckets, self.levels = state["buckets"], [(r["folder"], r["level"]) for r in state["runs"]]
        self._tables: dict[str, str] = {}

    def _open(self, folder: str) -> DataFrame:
        """A run as a table that the planner knows to be bucketed and sorted."""
        if folder not in self._tables:
            self._tables[folder] = f"llm_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self._tables[folder]} ({_RUN}) USING parquet "
                f"CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
            )
        return self.spark.table(self._tables[folder])

    def close(self) -> None:
        """Forget the tables of this session; the runs stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = {}

    def _sorted(self, rows: DataFrame, path: str) -> str:
        """``rows`` dealt and sorted by hash at ``path``, as the table whose name is returned."""
        name = f"llm_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "h").write.format("parquet").option("path", path)
            .option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        )
        return name

    def _new_run(self, hashes: DataFrame) -> str:
        """``hashes`` as a new run that no list names yet."""
        folder = f"run-{uuid.uuid4().hex}"
        self._tables[folder] = self._sorted(hashes.select("h", "holder"), f"{self.path}/{folder}")
        return folder

    def _publish(self, levels: list[tuple[str, int]]) -> None:
        """List ``levels``. The slower of two writers on one store fails here, and its batch has to be added again."""
        runs = [{"folder": f, "level": level} for f, level in levels]
        self.versions.publish(self.number + 1, {"buckets": self.buckets, "runs": runs})
        self.number, self.levels = self.number + 1, levels

    def compact(self) -> None:
        """Merge the runs of every level that has ``fan_in`` of them into one of the next level."""
        level = 0
        while level <= max((n for _, n in self.levels), default=-1):
            full = [f for f, n in self.levels if n == level]
            if len(full) >= self.fan_in:
                merged = self._new_run(reduce(DataFrame.unionByName, map(self._open, full)))
                self._publish([(f, n) for f, n in self.levels if f not in full] + [(merged, level + 1)])
            level += 1

    def hashes(self) -> DataFrame:
        """``h, holder``: every line hash seen so far, with the id of the document that keeps its line."""
        if not self.levels:
            return self.spark.createDataFrame([], _RUN)
        return reduce(DataFrame.unionByName, (self._open(f) for f, _ in self.levels))

    def add(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        min_chars: int = MIN_CHARS,
        with_text: bool = True,
    ) -> DataFrame:
        """Deduplicate the batch ``docs`` against all earlier ones and itself, and remember its lines.

        Returns ``doc_id, n_lines, n_dropped, text`` (or ``kept_sha256`` for ``text``) of every row. A line
        goes if a run has its key; or else if a smaller id of the batch has it. Other cases
        as in ``drop_repeated_lines``.
        """
        return self._add(store_lines(docs, id_col, text_col), min_chars, with_text)

    def _add(self, rows: DataFrame, min_chars: int, with_text: bool) -> DataFrame:
        self.compact()
        lines = rows.select("part", "pos", "d", F.posexplode(line_keys(F.col("text"))).alias("line", "key"))
        lines = lines.filter(F.length("key") >= min_chars).select(
            "part", "d", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("h"),
            (F.shiftleft("pos", _PLACE_BITS) + F.col("line")).alias("place"),
        )
        # The rows of a part lie together, so this moves nothing, and a line that most
        # documents have is one row per part from here on.
        met = lines.groupBy("part", "h").agg(
            F.min("d").alias("first"), F.max("d").alias("last"), F.collect_list(F.struct("place", "d")).alias("places")
        )
        name = self._sorted(met, scratch_path(self.spark, "lines"))
        met = self.spark.table(name)
        fresh = met.groupBy("h").agg(F.min("first").alias("holder"))
        for folder, _ in self.levels:
            fresh = fresh.join(self._open(folder).select("h").hint("merge"), "h", "left_anti")
        folder = self._new_run(fresh)
        told = met.join(self._open(folder).hint("merge"), "h", "left")
        told = told.filter("holder is null or first != holder or last != holder")
        places = told.select("part", "holder", F.inline("places")).filter("holder is null or d != holder")
        dropped = places.select(
            "part", F.shiftright("place", _PLACE_BITS).alias("pos"),
            F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("line"),
        )
        with placed_by_part(self.spark):
            result = materialize(_rebuilt(rows, dropped, with_text), "kept")
        self._publish([*self.levels, (folder, 0)])
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return result


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))


def store_lines(docs: DataFrame, id_col: str, text_col: str, batch: Column | None = None) -> DataFrame:
    """``part, pos, doc_id, d, text`` in a folder per ``batch``, stored where the rows lie: texts aren't moved."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_col).alias("doc_id"), _id(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.lit(0) if batch is None else batch).alias("batch"),
    )
    name = f"llm_lined_{uuid.uuid4().hex}"
    (
        numbered(texts).write.format("parquet").option("path", scratch_path(spark, "lined"))
        .option("compression", "zstd").partitionBy("batch").bucketBy(part_buckets(spark), "part").saveAsTable(name)
    )
    return spark.table(name)


def _rebuilt(rows: DataFrame, dropped: DataFrame, with_text: bool) -> DataFrame:
    """The documents of ``rows`` without their ``dropped`` lines; only line numbers move."""
    lost = dropped.repartition(part_buckets(rows.sparkSession), "part").groupBy("part", "pos").agg(F.collect_list("line").alias("lost"))
    split = rows.join(lost, ["part", "pos"], "left").withColumn("lines", F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    lines = F.col("lines")
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("text") if with_text else F.sha2(text, 256).alias("kept_sha256"),
    )


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
    with_text: bool = True,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` (or ``kept_sha256``) of every row of ``docs``.

    A key of ``min_chars`` code points or more that several documents hold stays, with all its
    lines, in the one with the smallest id; the other documents lose theirs. To this end the table
    is added to a new store in ``batches`` ranges of ids, smallest first.

    Texts are stored once and never moved; a row per part and line goes to the hash and, for
    lines that are dropped, back. A null or empty text is one empty line. Rows with equal ids are one
    document; a null id counts as the smallest one. Ids are integers. A text
    without lines that stay is empty. An empty table gives no rows; other columns
    of ``docs`` are not read.
    """
    spark = docs.sparkSession
    cuts = [(i + 1) / batches for i in range(batches - 1)]
    borders = docs.select(_id(id_col).alias("d")).agg(F.percentile_approx("d", cuts)).first()[0] if cuts else None
    batch = sum((F.when(_id(id_col) > b, 1).otherwise(0) for b in borders or ()), F.lit(0))
    rows = store_lines(docs, id_col, text_col, batch)
    store = LineRuns(spark, scratch_path(spark, "line-runs"), fan_in)
    kept = [store._add(rows.filter(F.col("batch") == b), min_chars, with_text) for b in range(batches)]
    store.close()
    return reduce(DataFrame.unionByName, kept)
