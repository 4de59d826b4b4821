"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.common import batched, rows_of, texts
from passageloom.llm.parts import store_parts

THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are learned; every other table is read whole."""

    sample: int = 20_000
    shards: int = 8
    rounds: int = 4
    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001


def _shape(token: str) -> str:
    """What kind of word a token is; marks are their own kind."""
    if not token[0].isalnum():
        return token[:4]
    if token.isdigit():
        return "0"
    if token.isupper():
        return "A" if len(token) > 1 else "a"
    return "a"


class Features:
    """Hashed 1- and 2-grams of a text's words and of their kinds, each family with a weight of 1 in all."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.memo: dict[str, int] = {}
        self.kinds: dict[str, int] = {}

    def _hash(self, token: str) -> tuple[int, int]:
        word = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass"))
        kind = xxhash.xxh64_intdigest(_shape(token).encode("utf-8", "surrogatepass"), seed=1)
        return word, kind

    def indices(self, text: str) -> list[np.ndarray]:
        """One array of indices per family; a feature occurs as often as in the text."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.memo) > _MEMO:
            self.memo.clear()
        memo, made = self.memo, self._hash
        pairs = []
        for token in tokens:
            pair = memo.get(token)
            if pair is None:
                pair = memo[token] = made(token)
            pairs.append(pair)
        hashes = np.array(pairs, dtype=np.uint64)
        words, kinds = hashes[:, 0], hashes[:, 1]
        families = [words, kinds]
        if len(tokens) > 1:
            odd = np.uint64(0x9E3779B97F4A7C15)
            families.append(words[:-1] * odd + words[1:])
            # The kind of a pair also says whether both words are the same.
            families.append(kinds[:-1] * odd + kinds[1:] + (words[:-1] == words[1:]).astype(np.uint64))
        return [self._place(family, i) for i, family in enumerate(families)]

    def _place(self, family: np.ndarray, number: int) -> np.ndarray:
        mixed = (family + np.uint64(number)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) & self.mask).astype(np.int64)

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indices and their values."""
        families = self.indices(text)
        if not families:
            return np.empty(0, np.int64), np.empty(0)
        values = np.concatenate([np.full(len(f), 1.0 / len(f)) for f in families])
        where, inverse = np.unique(np.concatenate(families), return_inverse=True)
        return where, np.bincount(inverse, values)

    def dot(self, text: str, weights: np.ndarray) -> float:
        """The dot product of the sparse features with ``weights``."""
        return float(sum(weights[f].sum() / len(f) for f in self.indices(text)))


def leader(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights that minimise the regularised sum of all gradients so far."""
    shrunk = np.sign(z) * s.l1 - z
    return np.where(np.abs(z) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass over ``rows`` in order; the last coordinate is the bias. Changes ``z`` and ``n``."""
    bias = len(z) - 1
    for where, values, label in rows:
        where, values = np.append(where, bias), np.append(values, 1.0)
        zs, ns = z[where], n[where]
        weights = leader(zs, ns, s)
        gradient = (1.0 / (1.0 + np.exp(-np.clip(weights @ values, -35, 35))) - label) * values
        squared = gradient * gradient
        z[where] = zs + gradient - (np.sqrt(ns + squared) - np.sqrt(ns)) / s.alpha * weights
        n[where] = ns + squared


def _shard(z0: np.ndarray, n0: np.ndarray, s: Settings):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n = z0.copy(), n0.copy()
        pdf = pdf.sort_values(["key", "label"])
        learn(list(zip(pdf["at"], pdf["v"], pdf["label"])), z, n, s)
        used = np.flatnonzero((z != 0) | (n != 0))
        return pd.DataFrame({"i": used, "z": z[used], "n": n[used]})

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights, learned from ``labels`` (``doc_id, label``); texts come from ``docs`` (``doc_id, text``).

    The sample is the ``settings.sample`` labelled ids with the smallest hashes
    (all, if there are fewer), so the joined side has a fixed bound. Shards learn
    side by side and their states are averaged after every round; a state has
    ``2**bits`` coordinates at most, whatever the input. Without usable labels
    all weights are 0 and every score is 0.5.
    """
    size = (1 << settings.bits) + 1
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    sample = (
        usable.select("doc_id", F.col("label").cast("int").alias("label")).distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.sample)
    )
    found = docs.join(F.broadcast(sample), "doc_id")
    schema = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(settings.bits)

        def rows():
            for key, label, text in rows_of(batches, "key", "label", "text"):
                where, values = features.sparse(text)
                yield key, label, where.astype(np.int32), values

        yield from batched(rows(), schema, 500)

    keyed = found.select(F.xxhash64("doc_id", "text").alias("key"), "label", "text")
    made = keyed.mapInArrow(extract, "key long, label int, at array<int>, v array<float>")
    # Stored by shard, so that no round shuffles the examples again.
    examples = store_parts(made.withColumn("part", F.pmod("key", F.lit(settings.shards))), "examples")

    z, n = np.zeros(size), np.zeros(size)
    for _ in range(settings.rounds):
        parts = examples.groupBy("part").applyInPandas(_shard(z, n, settings), "i long, z double, n double")
        merged = parts.groupBy("i").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        if merged.empty:
            break
        z, n = np.zeros(size), np.zeros(size)
        z[merged["i"]], n[merged["i"]] = merged["z"], merged["n"]
    return leader(z, n, settings)


def score(docs: DataFrame, weights: np.ndarray, bits: int = Settings.bits) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``, the probability of label 1; without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), shared.value

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                yield doc, float(1.0 / (1.0 + np.exp(-np.clip(features.dot(text, w) + w[-1], -35, 35))))

        yield from batched(rows(), schema)

    return docs.mapInArrow(apply, "doc_id long, score double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings = Settings(),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, score, predicted`` for every row; learns from all rows of ``labels`` that are passed in.

    Whole texts are scored; a null or empty text gets the score of the bias. Null
    ids are scored and never learned; null labels and labels other than 0 and 1 are
    left out; an id with both labels is learned with both. Repeated rows stay. Only
    the text enters a score. An empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    scored = score(rows, train(rows, named, settings), settings.bits)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings = Settings(),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with all their columns; without a shuffle."""
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    weights = docs.sparkSession.sparkContext.broadcast(train(texts(docs, id_col, text_col), named, settings))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, w = Features(settings.bits), weights.value
        for batch in batches:
            dots = np.array([features.dot(text, w) for text in batch], np.float64) + w[-1]
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(dots, -35, 35))))

    return docs.filter(probability(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
