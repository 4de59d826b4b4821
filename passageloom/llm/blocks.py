"""Texts stored in blocks of bounded size, and replies that come back to them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.common import rows_of
from passageloom.llm.parts import store_parts

BLOCK_CHARS = 1 << 20
_BLOCK_ROWS = 4000
_FILE_BLOCKS = 16


def store_blocks(docs: DataFrame, name: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``part, block, n_chars, doc_ids, texts, flags``: about ``block_chars`` characters of ``docs`` per row.

    ``docs`` has ``doc_id, text, flag``; nulls among texts and flags are not allowed.
    A longer text is a block of its own. Blocks are written once and bucketed by
    ``part``, the task that made them, so every later pass sees the same blocks
    and answers find them without moving a text. A file has few blocks, so that what
    a task reads at once doesn't follow the size of its part.
    """
    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("n_chars", pa.int64()),
         ("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())),
         ("flags", pa.list_(pa.bool_()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def block(ids, texts, flags, size):
            columns = [[part], [number], [size], [ids], [texts], [flags]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        ids, texts, flags, size = [], [], [], 0
        for doc, text, flag in rows_of(batches, "doc_id", "text", "flag"):
            if ids and (size + len(text) > block_chars or len(ids) >= _BLOCK_ROWS):
                yield block(ids, texts, flags, size)
                number += 1
                ids, texts, flags, size = [], [], [], 0
            ids.append(doc)
            texts.append(text)
            flags.append(flag)
            size += len(text)
        if ids:
            yield block(ids, texts, flags, size)

    ddl = "part int, block int, n_chars long, doc_ids array<long>, texts array<string>, flags array<boolean>"
    return store_parts(docs.mapInArrow(run, ddl), name, _FILE_BLOCKS)


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with a block each as Python values, one at a time: a batch has many."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def bring(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """``blocks`` with a column ``name``: its replies (``owner, reply``), or null.

    Only ``part`` is an equality for the planner, so the stored blocks stay where
    they are and the replies move; the block number is compared row by row.
    """
    own = replies.groupBy(F.col("part").alias("_part"), F.col("block").alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("owner", "reply"))).alias(name)
    )  # one row per block, with at most one reply per owner
    same = (F.col("part") == F.col("_part")) & (F.col("block") >= F.col("_block")) & (F.col("block") <= F.col("_block"))
    return blocks.join(own.hint("shuffle_hash"), same, "left").drop("_part", "_block")
