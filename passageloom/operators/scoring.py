"""BLEU and ROUGE of (reference, candidate) pairs, row by row.

Nothing crosses rows: both texts of a pair are tokenized in the JVM, and one
Arrow function stems, counts and matches them. No pair is moved, and pairs need
no key: rows with the same or no id are scored like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageloom.functions.stemming import long_stems, stem
from passageloom.functions.text import tokens
from passageloom.functions.words import common_subsequence

BLEU_ORDERS = (1, 2, 3, 4)
SCORES = ["bleu", "rouge1", "rouge2", "rouge_l"]


def _grams(toks: list[str], n: int) -> Counter:
    return Counter(zip(*(toks[i:] for i in range(n))))


def _matches(left: list[str], right: list[str], n: int) -> int:
    """How many n-grams of ``left`` find one of their own in ``right``."""
    if min(len(left), len(right)) < n:
        return 0
    counts = _grams(right, n)
    return sum(min(k, counts[gram]) for gram, k in _grams(left, n).items() if gram in counts)


_GRAM = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n_grams", T.LongType())])
_TEXTS = 100  # texts whose n-grams are in memory at once


def count_texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The n-grams of token texts and how often each occurs, some texts at a time: a batch has many."""
    for texts, orders in batches:
        for i in range(0, len(texts), _TEXTS):
            some = zip(texts.iloc[i : i + _TEXTS], orders.iloc[i : i + _TEXTS])
            found = (_grams(text.split(" ") if text else [], n) for text, n in some)
            rows = [[{"gram": " ".join(g), "n_grams": c} for g, c in grams.items()] for grams in found]
            yield pd.Series(rows, dtype=object)


@F.pandas_udf(T.ArrayType(_GRAM))
def _counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from count_texts(batches)


def ngram_counts(df: DataFrame, n: int, key: str = "pair_id", text: str = "text", tokenizer: str = "unicode") -> DataFrame:
    """``(key, gram, n_grams)``: how often each n-gram occurs in each text, text by text."""
    # No token holds a space, so the tokens travel as one text.
    joined = F.array_join(tokens(F.col(text), tokenizer), " ")
    return df.select(key, F.inline(_counted(joined, F.lit(n))))


def _overlap(orders: dict[str, tuple[int, ...]], subsequence: bool, stemmed: bool):
    """An Arrow function of the BLEU tokens and the ROUGE tokens of a pair.

    Its struct has, for each token kind ``name`` and order ``n``, ``name_n_hit``,
    ``name_n_c`` and ``name_n_r``; with ``subsequence`` also ``lcs``.
    """
    names = [f"{name}_{n}_{label}" for name, ns in orders.items() for n in ns for label in ("hit", "c", "r")]
    names += ["lcs"] * subsequence

    @F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in names]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        stems = long_stems() if stemmed else list
        for batch in batches:
            rows = []
            for b_c, b_r, r_c, r_r in zip(*batch):
                sides = {"b": (list(b_c), list(b_r)), "r": (stems(r_c), stems(r_r))}
                row = []
                for name, ns in orders.items():
                    for n in ns:
                        c, r = sides[name]
                        row += [_matches(c, r, n), max(len(c) - n + 1, 0), max(len(r) - n + 1, 0)]
                rows.append([*row, common_subsequence(*sides["r"])] if subsequence else row)
            yield pd.DataFrame(rows, columns=names, dtype="int64")

    return run


def _overlaps(
    pairs: DataFrame,
    orders: dict[str, tuple[int, ...]],
    subsequence: bool = False,
    bleu_tokenizer: str = "13a",
    tokenizer: str = "ascii",
    stemmed: bool = False,
) -> DataFrame:
    """``pairs`` with the overlap columns; token kinds that are not asked for are not made."""
    none = F.array().cast("array<string>")

    def sides(used: bool, kind: str) -> list[Column]:
        return [tokens(F.col(c), kind) if used else none for c in ("candidate", "reference")]

    toks = sides("b" in orders, bleu_tokenizer) + sides("r" in orders or subsequence, tokenizer)
    counted = _overlap(orders, subsequence, stemmed)(*toks)
    return pairs.withColumn("_overlap", counted).select(*pairs.columns, "_overlap.*")


def _bleu(name: str) -> Column:
    """Sentence BLEU from overlap columns, 0 to 100."""

    def part(n: int, label: str) -> Column:
        return F.col(f"{name}_{n}_{label}").cast("double")

    def add(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, columns)

    logs, used = [], []
    for n in BLEU_ORDERS:
        # The z-th order without a match counts as 1 / 2^z of one match.
        empty = [F.when((part(m, "c") > 0) & (part(m, "hit") == 0), 1).otherwise(0) for m in range(1, n + 1)]
        precision = F.when(part(n, "hit") == 0, 100 / (F.pow(F.lit(2.0), add(empty)) * part(n, "c"))).otherwise(
            100 * part(n, "hit") / part(n, "c")
        )
        logs.append(F.when(part(n, "c") > 0, F.log(precision)).otherwise(0.0))
        used.append(F.when(part(n, "c") > 0, 1).otherwise(0))
    brevity = F.when(part(1, "c") < part(1, "r"), F.exp(1 - part(1, "r") / part(1, "c"))).otherwise(1.0)
    matched = add([part(n, "hit") for n in BLEU_ORDERS]) > 0
    return F.when(matched, brevity * F.exp(add(logs) / add(used))).otherwise(0.0)


def _f_measure(hit: Column, c: Column, r: Column) -> Column:
    return F.when(c + r > 0, 2.0 * hit / (c + r)).otherwise(0.0)


def _rouge(name: str, n: int) -> Column:
    return _f_measure(*[F.col(f"{name}_{n}_{label}") for label in ("hit", "c", "r")])


def score_bleu(pairs: DataFrame, tokenizer: str = "13a") -> DataFrame:
    """``(pair_id, bleu)``: sentence BLEU with up to four orders."""
    overlaps = _overlaps(pairs.select("pair_id", "reference", "candidate"), {"b": BLEU_ORDERS}, bleu_tokenizer=tokenizer)
    return overlaps.select("pair_id", _bleu("b").alias("bleu"))


def score_rouge_n(pairs: DataFrame, n: int, tokenizer: str = "ascii", stemmed: bool = True) -> DataFrame:
    """``(pair_id, rouge<n>)``: F measure of matching n-grams."""
    pairs = pairs.select("pair_id", "reference", "candidate")
    overlaps = _overlaps(pairs, {"r": (n,)}, tokenizer=tokenizer, stemmed=stemmed)
    return overlaps.select("pair_id", _rouge("r", n).alias(f"rouge{n}"))


def _rouge_l() -> Column:
    return _f_measure(F.col("lcs"), F.col("r_1_c"), F.col("r_1_r"))


def score_rouge_l(pairs: DataFrame, tokenizer: str = "ascii", stemmed: bool = True) -> DataFrame:
    """``(pair_id, rouge_l)``: F measure of the longest common subsequence of tokens."""
    pairs = pairs.select("pair_id", "reference", "candidate")
    overlaps = _overlaps(pairs, {"r": (1,)}, True, tokenizer=tokenizer, stemmed=stemmed)
    return overlaps.select("pair_id", _rouge_l().alias("rouge_l"))


def score_pairs(pairs: DataFrame, tokenizer: str = "ascii", stemmed: bool = True, bleu_tokenizer: str = "13a") -> DataFrame:
    """The pair table with ``bleu``, ``rouge1``, ``rouge2`` and ``rouge_l`` added.

    The defaults are those of the usual scorers: 13a tokens for BLEU, stemmed
    lower-case ASCII tokens for ROUGE.
    """
    overlaps = _overlaps(pairs, {"b": BLEU_ORDERS, "r": (1, 2)}, True, bleu_tokenizer, tokenizer, stemmed)
    return overlaps.select(
        *pairs.columns,
        _bleu("b").alias("bleu"),
        _rouge("r", 1).alias("rouge1"),
        _rouge("r", 2).alias("rouge2"),
        _rouge_l().alias("rouge_l"),
    )


def stem_vocabulary(words: DataFrame, col: str = "token") -> DataFrame:
    """``(token, stem)`` of the distinct tokens, which are found before any Python runs."""
    return words.select(F.col(col).alias("token")).distinct().withColumn("stem", stem(F.col("token")))
