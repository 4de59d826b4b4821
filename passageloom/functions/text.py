"""Column functions for text, replies and timestamps. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.split() treats as white space.
WHITESPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Patterns of the tokenizers.
UNICODE_TOKEN = r"[\p{L}\p{N}]+"
ASCII_TOKEN = r"[a-z0-9]+"

# The published mteval-v13a rules, applied in this order.
MTEVAL_13A = [
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]

# Time zones of the activity log.
LOG_SOURCE_ZONE = "America/Los_Angeles"
LOG_TARGET_ZONE = "America/Bogota"


def clean_page_text(col: Column) -> Column:
    """Replace newline and NUL by a space."""
    return F.translate(col, "\n\u0000", "  ")


def strip_space(col: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(col, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def limit_words(col: Column, n: int) -> Column:
    """First ``n`` words joined by single spaces; shorter text stays as it is."""
    if not 1 <= n <= 32000:
        raise ValueError("n must be between 1 and 32000")
    # n + 1 pieces tell whether the text is longer; the rest is never split.
    words = F.split(strip_space(col), f"{WHITESPACE}+", n + 1)
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(col)


def strip_quotes(col: Column) -> Column:
    """Remove single quotes."""
    return F.replace(col, F.lit("'"), F.lit(""))


def escape_dollar(col: Column) -> Column:
    """Put a backslash before every dollar sign."""
    return F.replace(col, F.lit("$"), F.lit("\\$"))


def extract_answer(col: Column, path: str = "$.choices[0].messages") -> Column:
    """The answer inside the JSON text of a model reply."""
    return F.get_json_object(col, path)


def fallback_answer(col: Column, default: str) -> Column:
    """``default`` where the answer is missing or empty."""
    return F.when(col.isNull() | (col == ""), F.lit(default)).otherwise(col)


def answer_or_error(reply: Column, missing: str, error: str, path: str = "$.choices[0].messages") -> Column:
    """Answer of a reply, with one text for no answer and another for a bad reply.

    No reply, a null answer and an empty answer give ``missing``; text that is
    not JSON, or lacks the path, gives ``error``.
    """
    found = F.try_variant_get(F.try_parse_json(reply), path, "variant")
    return (
        F.when(reply.isNull(), F.lit(missing))
        .when(found.isNull(), F.lit(error))
        .when(F.is_variant_null(found), F.lit(missing))
        .otherwise(fallback_answer(extract_answer(reply, path), missing))
    )


def convert_tz(col: Column, src: str = LOG_SOURCE_ZONE, dst: str = LOG_TARGET_ZONE) -> Column:
    """Wall-clock time of zone ``src`` as wall-clock time of zone ``dst``."""
    return F.convert_timezone(F.lit(src), F.lit(dst), col)


def tokens(col: Column, tokenizer: str = "unicode") -> Column:
    """Array of tokens; NULL text gives an empty array."""
    if tokenizer == "unicode":
        found = F.regexp_extract_all(F.lower(col), F.lit(UNICODE_TOKEN), F.lit(0))
    elif tokenizer == "ascii":
        found = F.regexp_extract_all(F.lower(col), F.lit(ASCII_TOKEN), F.lit(0))
    elif tokenizer == "13a":
        spaced = F.concat(F.lit(" "), col, F.lit(" "))
        for pattern, replacement in MTEVAL_13A:
            spaced = F.regexp_replace(spaced, pattern, replacement)
        found = F.filter(F.split(spaced, f"{WHITESPACE}+"), lambda t: t != "")
    else:
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    return F.coalesce(found, F.array().cast("array<string>"))


def ngrams(toks: Column, n: int) -> Column:
    """The n-grams of a token array, each joined by spaces."""
    if n == 1:
        return toks
    grams = F.transform(
        F.sequence(F.lit(1), F.size(toks) - (n - 1)),
        lambda i: F.array_join(F.slice(toks, i, n), " "),
    )
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))
