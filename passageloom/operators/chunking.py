"""Split texts into overlapping chunks.

Both forms work row by row without a shuffle. A text is one row, so the work
of one task is bounded by the size of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageloom.functions.words import word_chunks

# Chunk size and overlap in characters.
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 300

_TEXTS = 100  # texts whose chunks are in memory at once


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")


def split_texts(batches: Iterator[pd.Series], size: int, overlap: int) -> Iterator[pd.Series]:
    """The chunks of each text, some texts at a time: a batch has many, and their words and chunks take more than they do."""
    for texts in batches:
        for i in range(0, len(texts), _TEXTS):
            some = texts.iloc[i : i + _TEXTS]
            yield some.map(lambda text: None if text is None else word_chunks(text, size, overlap))


def word_chunk_array(col: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of word-boundary chunks of a text, computed on Arrow batches."""
    _check(size, overlap)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from split_texts(batches, size, overlap)

    return split(col)


def char_chunk_array(col: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of character windows of a text, computed in the JVM."""
    _check(size, overlap)
    step = size - overlap
    last = F.ceil(F.greatest(F.length(col) - size, F.lit(0)) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(col, i * step + 1, F.lit(size)))
    return F.when(F.length(col) > 0, windows)


def _lateral(df: DataFrame, text_col: str, chunks: Column) -> DataFrame:
    """Join every row with its chunks; rows without chunks drop out."""
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(chunks).alias("chunk_no", "chunk"))


def chunk_words(df: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per word-boundary chunk: the other columns, ``chunk_no``, ``chunk``."""
    return _lateral(df, text_col, word_chunk_array(F.col(text_col), size, overlap))


def chunk_chars(df: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per character window: the other columns, ``chunk_no``, ``chunk``."""
    return _lateral(df, text_col, char_chunk_array(F.col(text_col), size, overlap))


@F.udtf(returnType="chunk_no int, chunk string", useArrow=True)
class ChunkWords:
    """Table function form of the word chunks, for lateral joins in SQL."""

    def eval(self, text: str, size: int, overlap: int):
        _check(size, overlap)
        if text is not None:
            yield from enumerate(word_chunks(text, size, overlap))


def register_chunk_words(spark: SparkSession, name: str = "chunk_words") -> None:
    """Make ``SELECT ... FROM docs, LATERAL chunk_words(text, 2000, 300)`` available."""
    spark.udtf.register(name, ChunkWords)
