"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageloom.llm.common import WORD
from passageloom.llm.parts import bring_digits, store_documents, unpack_documents
from passageloom.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Expected rows of a bucket, and buckets of a superbucket: the size of every window here.
BUCKET_ROWS = 256
SUPER_BUCKETS = 4096

_KEY_BITS = 60


def shuffle_key(id_col: Column) -> Column:
    """A place in the shuffled order: the first 60 bits of the id's MD5, the same in every run."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def _before(df: DataFrame, by: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier buckets of each group: over superbuckets first, then inside each."""
    fine = df.withColumn("_super", (F.col(bucket) / SUPER_BUCKETS).cast("long"))
    coarse = fine.groupBy(*by, "_super").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*by, "_super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        fine.join(coarse, [*by, "_super"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_super", "_base")
    )


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``_s, rank, source_size, target``, one row per source (``_s`` is never null).

    Sources in the order of their smallest fill level are full (capped) as
    long as the level that the rest would share reaches them; what they cannot
    hold is shared by the others by weight. One row per source is ordered in
    one task: a list of sources is small beside the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = (
        sized.groupBy("source", "_s").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("rank") % len(weights) + 1))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    rows, everything = Window.unboundedPreceding, Window.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = ranked.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "room": F.sum("source_size").over(everything)
            - F.coalesce(F.sum("cap").over(by_level.rowsBetween(rows, -1)), F.lit(0.0)),
            "share": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("capped", F.col("cap") * F.col("share") <= F.col("room") * F.col("weight"))
    level = left.withColumns(
        {
            "rest": F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything),
            "open": F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything),
        }
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("rest") * F.col("weight") / F.col("open"))
    return level.select("_s", F.col("rank").cast("long").alias("rank"), "source_size", "total", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document, with the columns ``keep`` of ``docs``.

    The queue of a source is its documents in shuffled order, repeated up to
    ``max_epochs`` times, as far as its target. A copy's virtual finish time is
    the number of words of its source up to and with it, divided by the target.
    In the order of these times the copies are taken up to the total budget,
    which is the number of words of all documents.

    No row's text is moved: sizes are stored first. Finish times need sums over
    a whole source; these come from buckets of the shuffled order whose expected
    size is fixed, so a source that holds most rows is split like any other.
    The border lies in one bucket of finish times; only that is ordered.

    A null or empty text has size 0 and is never taken. Null sources form one
    source, ranked last. Null or repeated ids are separate rows with one place
    in the shuffled order, the smaller first. An empty table gives no rows;
    columns with clashing names are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.struct(*(F.col(c) for c in keep)).alias("_keep") if keep else F.lit(None).cast("int").alias("_keep"),
    )
    sized = materialize(
        chosen.withColumns(
            {"_key": shuffle_key(F.col("doc_id")), "_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}
        ),
        "sized",
    )
    buckets = sized.count() // BUCKET_ROWS + 1
    sized = sized.withColumn("_bucket", F.floor(F.col("_key") / float(1 << _KEY_BITS) * buckets))

    sums = sized.groupBy("_s", "_bucket").agg(F.sum("size").alias("_size"))
    # A null-free key; the list of sources is small, and the optimizer checks its size before it broadcasts it.
    places = _before(sums, ["_s"], "_bucket", "_size", "_start").join(
        source_targets(sized, weights, max_epochs), "_s"
    ).drop("_size")
    order = Window.partitionBy("_s", "_bucket").orderBy("_key", "doc_id", "size")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    queued = materialize(
        sized.withColumn("_inside", inside)
        .join(places, ["_s", "_bucket"])
        .withColumn("_end", F.col("_start") + F.col("_inside"))
        .select("doc_id", "size", "source_size", "target", "total", "rank", "_end", "_keep"),
        "queued",
    )

    def finish(epoch: Column | int) -> Column:
        return (F.col("source_size") * epoch + F.col("_end")).cast("double") / F.col("target")

    def queued_at(epoch: Column | int) -> Column:
        start = (F.col("source_size") * epoch + F.col("_end") - F.col("size")).cast("double")
        return (F.col("size") > 0) & (start < F.col("target"))

    copies = queued.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long"))))
    copies = copies.filter(queued_at(F.col("_epoch"))).select(
        "size", "rank", "total", finish(F.col("_epoch")).alias("_finish")
    )
    # A copy finishes at or after 1 at most once per source, so the last bucket is small too.
    copies = copies.withColumn("_slot", F.least(F.floor(F.col("_finish") * buckets), F.lit(buckets)))
    slots = copies.groupBy("_slot").agg(F.sum("size").alias("_words"), F.max("total").alias("total"))
    slots = _before(slots.withColumn("_all", F.lit(0)), ["_all"], "_slot", "_words", "_sum")
    cut = slots.filter(F.col("_sum") + F.col("_words") >= F.col("total")).orderBy("_slot").select("_slot", "_sum").first()
    taken = F.lit(0).cast("long")
    # Every copy is taken if their words are just the budget, and none if there are no words.
    if cut is not None:
        slot, words = cut
        by_finish = Window.partitionBy("_slot").orderBy("_finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
        over = (
            copies.filter(F.col("_slot") == slot)
            .withColumn("_sum", F.sum("size").over(by_finish) + words)
            .filter(F.col("_sum") > F.col("total"))
            .orderBy("_finish", "rank").select("_finish", "rank").first()
        )
        for epoch in range(max_epochs):
            fits = queued_at(epoch)
            if over is not None:
                before = (finish(epoch) < over[0]) | ((finish(epoch) == over[0]) & (F.col("rank") < over[1]))
                fits = fits & before
            taken = taken + F.when(fits, F.col("size")).otherwise(0)
    kept = [F.col(f"_keep.{c}").alias(c) for c in keep]
    return queued.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *kept
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; cases as in ``mix``."""
    rows = store_documents(docs, id_col, text_col, "documents", source_col)
    mixed = mix(rows, "doc_id", "text", "source", weights, max_epochs, keep=("part", "pos"))
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int").cast("string")
    width = len(str(max_epochs))
    digits = mixed.select("part", "pos", F.lpad(copies, width, "0").alias("digit"))
    counted = bring_digits(rows, digits, "_copies", width).withColumn("_copies", F.col("_copies").cast("int"))
    taken = counted.filter("_copies > 0")
    repeated = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
    return unpack_documents(repeated, docs, text_col)
