"""Columns of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The named columns, or all if none is named."""
    return df.select(*columns) if columns else df


def with_language(df: DataFrame, lang: str | Column) -> DataFrame:
    """Tag rows with a constant language, or take it from a column."""
    return df.withColumn("language", F.lit(lang) if isinstance(lang, str) else lang)


def with_file_url(df: DataFrame, base: str) -> DataFrame:
    """Address of the file below ``base``."""
    return df.withColumn("file_url", F.concat(F.lit(base), F.col("relative_path")))


def with_title(df: DataFrame) -> DataFrame:
    """Put the file's path, a colon and a space before each chunk."""
    return df.withColumn("chunk", F.concat(F.col("relative_path"), F.lit(": "), F.col("chunk")))
