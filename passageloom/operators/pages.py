"""Assemble the pages of a file into one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.functions.text import clean_page_text
from passageloom.operators.joins import spread_join

# Fixed value: the marker that stands for unreadable pages.
UNREADABLE = "Unable to Extract"


def assemble_pages(
    pages: DataFrame,
    files: DataFrame | None = None,
    file_col: str = "relative_path",
    page_col: str = "page_no",
    text_col: str = "text",
    mode: str = "reference",
    sep: str = "",
) -> DataFrame:
    """One row per file: its cleaned page texts in order; NULL text is an unreadable page.

    ``mode="reference"``: an unreadable page replaces everything before it by
    a marker, so only pages after the last one matter. ``mode="skip"`` leaves
    unreadable pages out. With ``files``, a file without pages gets ``""``.
    The result is one string per file, so a group holds at most one row's text.
    """
    if mode not in ("reference", "skip"):
        raise ValueError(f"unknown mode: {mode}")
    text = clean_page_text(F.col(text_col))
    failed = pages.groupBy(file_col).agg(F.max(F.when(F.col(text_col).isNull(), F.col(page_col))).alias("_failed"))
    readable = spread_join(pages, failed, [file_col], [page_col]).filter(F.col(text_col).isNotNull())
    if mode == "reference":
        # Only pages that stay are collected.
        readable = readable.filter(F.col("_failed").isNull() | (F.col(page_col) > F.col("_failed")))
    lines = F.sort_array(F.collect_list(F.struct(F.col(page_col).alias("no"), text.alias("text"))))
    joined = readable.groupBy(file_col).agg(F.transform(lines, lambda p: p["text"]).alias("_parts"))
    parts = F.coalesce("_parts", F.array().cast("array<string>"))
    if mode == "reference":
        marker = F.when(F.col("_failed").isNotNull(), F.array(F.lit(UNREADABLE))).otherwise(F.array().cast("array<string>"))
        parts = F.concat(marker, parts)
    texts = failed.join(joined, file_col, "left").select(file_col, F.array_join(parts, sep).alias(text_col))
    if files is None:
        return texts
    return (
        files.select(file_col).join(texts, file_col, "left").withColumn(text_col, F.coalesce(text_col, F.lit("")))
    )
