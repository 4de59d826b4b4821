"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much go."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from passageloom.llm.common import LOWER, WHITE, batched, rows_of, texts

SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "•", ">")
# A word with two of these in a row is noise.
NOISE = r"[#*$%&!?|<>~^=_+]{2}"
# Marks that may end a line of prose.
CLOSING = r"""[.!?:;"')\]…。»”’]$"""
# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "licensed under the",
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our",
    "sign up for our",
    "powered by",
    "lorem ipsum",
)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_LOST_PERCENT = 50

_NOISE, _CLOSING = re.compile(NOISE), re.compile(CLOSING)
_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("n_lines", pa.int64()),
    ("n_removed_lines", pa.int64()),
    ("kept_word_chars", pa.int64()),
]
_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, kept_word_chars long"
)


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, WHITE))


def words(text: str) -> list[bytes]:
    # bytes.split() divides at exactly the six ASCII white-space characters.
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(tokens: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` words that the text has twice or more, each word once."""
    windows = list(zip(*(tokens[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = end = 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + size - max(start, end)
            end = start + size
    return covered


def line_fails(line: str, n_words: int) -> str | None:
    """Name of the first rule that a line with words fails, or None."""
    lowered = line.translate(LOWER)
    if any(phrase in lowered for phrase in BOILERPLATE):
        return "boilerplate"
    if any(mark in line for mark in SEPARATORS):
        marks = sum(w in SEPARATORS for w in line.replace("\t", " ").split(" "))
        if marks >= 2 and 5 * marks >= n_words:
            return "navigation"
    if not _CLOSING.search(line.rstrip(WHITE)):
        return "punctuation"
    if _NOISE.search(line):
        noisy = sum(bool(_NOISE.search(w)) for w in re.split(f"[{WHITE}]+", line))
        if 2 * noisy >= n_words:
            return "punctuation"
    return None


def clean_lines(text: str) -> tuple[str, int, int, int]:
    """Text of the lines that stay, lines with words, removed lines, and code points in the words that stay."""
    kept, n_lines, removed, chars = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(words(line))
        if not n:
            kept.append(line)
            continue
        n_lines += 1
        if line_fails(line, n):
            removed += 1
        else:
            kept.append(line)
            chars += word_chars(line)
    return "\n".join(kept), n_lines, removed, chars


def clean_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    max_lost_percent: int = MAX_LOST_PERCENT,
) -> DataFrame:
    """Counts, verdict and (``with_text``) the cleaned text of every document, without a shuffle.

    Whole texts are read. A null or empty text has no words: every count is 0,
    ``base_failed`` is true. Equal rows stay and get equal results; an empty
    table gives none. A document is kept if it passes the base rules and loses
    at most ``max_lost_percent`` of its word characters with its bad lines.
    """
    schema = pa.schema(_FIELDS + [("text", pa.string())] * with_text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                tokens = words(text)
                n, chars = len(tokens), word_chars(text)
                lines = [line for line in text.split("\n") if line.strip(WHITE)]
                repeats = repeated_words(tokens)
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
                cleaned, n_lines, removed, left = clean_lines(text)
                kept = not failed and 100 * (chars - left) <= max_lost_percent * chars
                row = (
                    doc, n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
                    failed, kept, n_lines, removed, left,
                )
                yield (*row, cleaned) if with_text else row

        yield from batched(rows(), schema)

    return texts(docs, id_col, text_col).mapInArrow(judge, _DDL + ", text string" * with_text)
