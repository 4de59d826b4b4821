"""Documents to chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom import schemas
from passageloom.functions.text import clean_page_text
from passageloom.operators.chunking import chunk_words
from passageloom.operators.corpus import with_file_url, with_language, with_title
from passageloom.operators.joins import spread_join
from passageloom.operators.paged_chunks import chunk_pages

FILE_BASE = "files://corpus/"


def staged_files(documents: DataFrame) -> DataFrame:
    """Documents named like files: ``source/doc_id.txt``."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", path.alias("relative_path"), F.col("lang").alias("language"), "text")


def chunk_table(
    files: DataFrame,
    base: str = FILE_BASE,
    language: str | None = None,
    chunker: Callable[[DataFrame], DataFrame] = chunk_words,
) -> DataFrame:
    """The chunk table of cleaned file texts; ``language`` overrides the file's own."""
    return _named(chunker(files.withColumn("text", clean_page_text(F.col("text")))), base, language)


def paged_chunk_table(
    files: DataFrame, pages: DataFrame, base: str = FILE_BASE, language: str | None = None, mode: str = "reference"
) -> DataFrame:
    """The chunk table of files given as ``pages`` (``relative_path, page_no, text``); ``files`` has their other columns.

    No file is assembled, so files may be of any size. Pages of files that ``files`` doesn't list are left out.
    """
    pieces = chunk_pages(pages, mode=mode)
    others = files.select("doc_id", "relative_path", "language")
    return _named(spread_join(pieces, others, ["relative_path"], ["chunk_no"]), base, language)


def _named(pieces: DataFrame, base: str, language: str | None) -> DataFrame:
    if language is not None:
        pieces = with_language(pieces, language)
    return with_title(with_file_url(pieces, base)).select(*schemas.CHUNKS.fieldNames())
