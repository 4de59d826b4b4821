"""From raw documents to a mixed, deduplicated and tokenized training set, stage by stage.

Every function takes ``(spark, docs, sf_dir)``; all but the last return the
columns of ``docs``. SQL can't express the classifier, so there is none for
the result; ``tests/llm`` hold it against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passageloom.llm import classifier, exact_dedup, mixing, near_dedup, pieces
from passageloom.llm.common import held_out, table
from passageloom.session import materialize, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _folders(spark: SparkSession) -> tuple[object, set[str]]:
    """The file system of the application's scratch folder, and the folders in it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x").rpartition("/")[0])
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(root) if files.exists(root) else []
    return files, {status.getPath().toString() for status in found}


def _tidy(spark: SparkSession, before: set[str], docs: DataFrame) -> None:
    """Deletes the folders made since there were those of ``before``, unless ``docs`` reads them."""
    files, now = _folders(spark)
    read = [path.split(":", 1)[-1].lstrip("/") for path in docs.inputFiles()]
    for folder in now - before:
        if not any(path.startswith(folder.split(":", 1)[-1].lstrip("/") + "/") for path in read):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels")
    return classifier.keep_good(docs, labels.filter(~held_out(labels["doc_id"], 4)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at a similarity of 0.8 of five-word shingles."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of every source as often as its weight asks for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids, round_trip`` of every document of the mix."""
    return pieces.encode(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("encode", encode)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    What a stage stored is deleted when its result has been written. A stage called
    on its own deletes nothing, as its result is lazy: ``session.drop_scratch`` does.
    One run at a time in an application.
    """
    docs = table(spark, sf_dir, "documents")
    _, before = _folders(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        _tidy(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
