"""Exact deduplication: compressed fingerprints find suspects, whole texts confirm them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.common import texts
from passageloom.llm.exchange import ask_owners, lowest, mark_duplicates, pack, split
from passageloom.llm.parts import numbered, store_documents, store_parts, unpack_documents
from passageloom.operators.joins import spread_join
from passageloom.session import materialize

# Expected fingerprints of one owner.
OWNER_KEYS = 1 << 18


def _suspects(rows: DataFrame, owners: int) -> DataFrame:
    """``part, flags``: a bitmap over the places of a part, set where another row has the same fingerprint."""
    prints = rows.select("part", "pos", "fp")

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        part = pdf["part"].iloc[0]
        found = [(part, 0, o, pack(keys[a:b], lowest(o, owners))) for o, a, b in split(keys, owners)]
        return pd.DataFrame(found, columns=["part", "block", "owner", "keys"])

    messages = prints.groupBy("part").applyInPandas(send, "part int, block int, owner int, keys binary")
    replies = ask_owners(messages, owners, mark_duplicates)

    def receive(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        keys, where, counts = np.unique(
            pdf["fp"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True
        )
        bits = {int(o): r for o, r in zip(answers["owner"], answers["reply"])}
        flags = counts > 1  # found in this part already
        for o, a, b in split(keys, owners):
            flags[a:b] |= np.unpackbits(np.frombuffer(bits[o], np.uint8), count=b - a).astype(bool)
        places = pdf["pos"].to_numpy()
        out = np.zeros(places.max() + 1, np.uint8)
        out[places] = flags[where]
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "flags": [out.tobytes()]})

    return prints.groupBy("part").cogroup(replies.groupBy("part")).applyInPandas(receive, "part int, flags binary")


def _marked(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` with ``suspect``: whether another row may have the same text."""
    owners = rows.count() // OWNER_KEYS + 1
    flags = materialize(_suspects(rows, owners), "flags")
    # One byte a row, so that a place is found without a search.
    suspect = F.substring("flags", F.col("pos").cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    return rows.join(flags, "part").withColumn("suspect", suspect).drop("flags")


def _groups(marked: DataFrame, *more) -> DataFrame:
    """``fp, sha, stays, group_size`` of the suspects, after a comparison of their bytes."""
    row = F.struct("doc_id", "part", "pos")
    groups = marked.filter("suspect").groupBy("fp", "sha").agg(
        F.max(row).alias("stays"), F.count(F.lit(1)).alias("group_size"), F.min("text").alias("text"),
        F.max("text").alias("last"), *more,
    )
    differ = F.raise_error(F.lit("two texts share a fingerprint and a SHA-256"))
    return groups.withColumn("stays", F.when(F.col("text") == F.col("last"), F.col("stays")).otherwise(differ)).drop("last")


def _prints(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fp": F.xxhash64("text"), "sha": F.unhex(F.sha2("text", 256))})


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Rows with identical texts form a group, in which the row with the largest id
    stays. Every partition sends its sorted, distinct 64-bit fingerprints to the
    owners of their ranges and gets a bitmap back; only the texts of marked rows
    are shuffled. There a group is a fingerprint and a SHA-256, and its least and
    greatest text have to be the same bytes. Groups are aggregated before they
    are shuffled, so any number of copies is a row per task.

    A null text counts as empty; empty texts are equal to each other. A null id is
    smaller than any; of rows with equal ids and texts one stays. An empty table
    gives no rows; columns of ``docs`` with clashing names are not read.
    """
    marked = _marked(store_parts(_prints(numbered(texts(docs, id_col, text_col))), "texts"))
    groups = materialize(_groups(marked).drop("text"), "groups")
    row = F.struct("doc_id", "part", "pos")
    columns = ["part", "pos", "doc_id", "fp", "sha"]
    found = spread_join(marked.filter("suspect").select(*columns), groups, ["fp", "sha"], ["part", "pos"])
    alone = marked.filter("not suspect").select(*columns).withColumns({"stays": row, "group_size": F.lit(1).cast("long")})
    return found.select(*columns, "stays", "group_size").unionByName(alone).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("stays") == row).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in ``deduplicate``.

    A null text comes out as an empty one. The row that stays of a group travels in
    the group's aggregate, so there is no second join.
    """
    filled = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    marked = _marked(_prints(store_documents(filled, id_col, text_col, "texts")))
    whole = F.max_by("_row", F.struct("doc_id", "part", "pos")).alias("_row")
    groups = _groups(marked, whole).filter("stays is not null").select("text", "_row")
    return unpack_documents(marked.filter("not suspect").select("text", "_row").unionByName(groups), docs, text_col)
