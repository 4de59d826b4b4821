"""Scores of texts under a word bigram model whose counts come from all training documents.

The model is a trie in shards. A shard owns a range of context nodes; a context
is dealt over ``_SPREAD`` nodes by its successors, so that a common word is no
hot key. Level one holds the node numbers, level two the successors of each
node, both as Elias-Fano sequences with monotone pointers between them, and one
byte per successor for the quantised, discounted probability of the pair.
A shard lives in its owner's task, is asked once and dropped; no model is kept.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageloom.llm.blocks import bring, each_block, store_blocks
from passageloom.llm.common import batched
from passageloom.llm.exchange import lowest, pack, split, unpack
from passageloom.llm.words import hash_words, mix
from passageloom.session import materialize

# Expected keys of one owner; characters per word to expect.
OWNER_KEYS = 1 << 21
_WORD_CHARS = 6
_SPREAD = 16
_ABSENT = 255
_START = np.uint64(0x0F4C_7B1D_93A5_E268)
_END = np.uint64(0x7A21_C9E4_5D80_36FB)
# A block's counts fit in 32 bits (a text has under 2**31 bytes); those of all training texts need not.
_TOTAL = np.uint64


@dataclass(frozen=True)
class Settings:
    mix: float = 0.5  # share of the bigram in the interpolation
    discount: float = 0.5
    levels: int = 254  # steps of the quantiser


def _places(bit: int) -> np.ndarray:
    """For every byte, the places of its bits that equal ``bit``, from the first."""
    table = np.zeros((256, 8), np.int64)
    for value in range(256):
        found = [i for i in range(8) if (value >> (7 - i)) & 1 == bit]
        table[value, : len(found)] = found
    return table


_BITS = np.array([value.bit_count() for value in range(256)], np.int64)
_PLACES = (_places(0), _places(1))


class EliasFano:
    """A sorted sequence of distinct integers in a bit over ``2 + log2(universe / n)`` bits each.

    Lower bits are packed; upper bits are unary. ``find`` looks values up by
    successor search: the upper bits give the short run in which the next value
    lies, the lower bits the place in it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # Eight bytes from any place on, without a copy.
        self.windows = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))
        ones = np.concatenate([[0], np.cumsum(_BITS[high])])
        self.counts = (8 * np.arange(len(ones)) - ones, ones)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(n + (universe >> low_bits) + 2, np.uint8)
        bits[upper + np.arange(n)] = 1
        low = []
        shifts = np.arange(low_bits, dtype=np.uint64)[::-1]
        for start in range(0, n, 1 << 16):  # a multiple of eight values fills whole bytes
            part = values[start : start + (1 << 16), None]
            low.append(np.packbits(((part >> shifts) & np.uint64(1)).astype(np.uint8).ravel()))
        return EliasFano(n, low_bits, np.concatenate([*low, np.zeros(16, np.uint8)]), np.packbits(bits))

    def _select(self, bit: int, rank: np.ndarray) -> np.ndarray:
        """Place of the bit of that value with the given rank (from 0)."""
        byte = np.searchsorted(self.counts[bit], rank, side="right") - 1
        return 8 * byte + _PLACES[bit][self.high[byte], rank - self.counts[bit][byte]]

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        window = self.windows[bit >> 3].astype(np.uint64)
        left = (bit & 7).astype(np.uint64)
        return (window << left) >> np.uint64(64 - self.low_bits)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element not below each value (``n`` if none), and whether it is the value."""
        upper = (values >> np.uint64(self.low_bits)).astype(np.int64)
        lower = values & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(upper > 0, self._select(0, np.maximum(upper - 1, 0)) - (upper - 1), 0)
        end = self._select(0, upper) - upper
        last = end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = self._lows(middle) < lower[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        inside = begin < last
        inside[inside] = self._lows(begin[inside]) == lower[inside]
        return begin, inside

    def values(self, at: np.ndarray) -> np.ndarray:
        """The elements at the given indices."""
        upper = (self._select(1, at) - at).astype(np.uint64)
        return (upper << np.uint64(self.low_bits)) | self._lows(at)


class Trie:
    """One shard: nodes, pointers to their successors, successors, and a code per successor."""

    def __init__(self, nodes: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray) -> None:
        self.nodes, self.pointers, self.successors, self.codes = nodes, pointers, successors, codes

    @staticmethod
    def build(keys: np.ndarray, codes: np.ndarray) -> Trie:
        """From sorted distinct keys, node in the upper and successor in the lower 32 bits."""
        owner = keys >> np.uint64(32)
        heads = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1)))
        rank = np.cumsum(np.diff(owner, prepend=owner[:1]) != 0).astype(np.uint64)
        # Successors are kept relative to their context's rank, which makes the level one monotone sequence.
        relative = (rank << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        ends = np.append(heads, len(keys)).astype(np.uint64)
        return Trie(
            EliasFano.build(owner[heads], 1 << 32),
            EliasFano.build(ends + np.arange(len(ends), dtype=np.uint64), 2 * len(keys) + 2),
            EliasFano.build(relative, (len(heads) + 1) << 32),
            codes,
        )

    def mapped(self, file) -> Trie:
        """The same shard with its levels in ``file``, mapped into memory."""
        parts = [x for level in (self.nodes, self.pointers, self.successors) for x in (level.low, level.high)]
        places = []
        for part in (*parts, self.codes):
            places.append((file.tell(), len(part)))
            file.write(part.tobytes() + bytes(-len(part) % 8))
        file.flush()
        view = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        arrays = [view[a : a + n] for a, n in places]
        levels = [
            EliasFano(old.n, old.low_bits, low, high)
            for old, low, high in zip((self.nodes, self.pointers, self.successors), arrays[0:6:2], arrays[1:6:2])
        ]
        return Trie(*levels, arrays[6])

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Codes of sorted keys; ``_ABSENT`` where the pair is not in the trie."""
        out = np.full(len(keys), _ABSENT, np.uint8)
        if self.nodes.n:
            for start in range(0, len(keys), 1 << 16):
                part = slice(start, start + (1 << 16))
                out[part] = self._some(keys[part])
        return out

    def _some(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), _ABSENT, np.uint8)
        context = keys >> np.uint64(32)
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        of_key = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        node, known = self.nodes.find(context[heads])
        node[~known] = 0
        begin = self.pointers.values(node).astype(np.int64) - node
        end = self.pointers.values(node + 1).astype(np.int64) - node - 1
        asked = np.flatnonzero(known[of_key])
        own = of_key[asked]
        wanted = (node[own].astype(np.uint64) << np.uint64(32)) | (keys[asked] & np.uint64(0xFFFFFFFF))
        at, found = self.successors.find(wanted)
        found &= (begin[own] <= at) & (at < end[own])
        out[asked[found]] = self.codes[at[found]]
        return out


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of word pairs: the node of the left word that this right word belongs to, and the right word."""
    node = mix(left * np.uint64(_SPREAD) + (right >> np.uint64(60))) >> np.uint64(32)
    return (node << np.uint64(32)) | (mix(right ^ (left * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32))


def _sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with an end after each, the token before each, and the number of tokens per text."""
    hashes, starts = hash_words(texts)
    sizes = np.diff(starts)
    tokens = np.insert(hashes, starts[1:], _END)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])] = _START
    return tokens, before, sizes + 1


def _keys(kind: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block, the key number of every token, and the text number of every token."""
    tokens, before, sizes = _sequences(texts)
    keys, where = np.unique(tokens if kind == "word" else pair_keys(before, tokens), return_inverse=True)
    return keys, where, np.repeat(np.arange(len(texts)), sizes)


def _messages(blocks: DataFrame, kind: str, owners: int) -> DataFrame:
    schema = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("owner", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for row in each_block(batches):
                keys, where, text = _keys(kind, row["texts"])
                learn = np.array(row["flags"])[text]
                counts = np.bincount(where[learn], minlength=len(keys)).astype(np.uint32)
                for owner, a, b in split(keys, owners):
                    packed = pack(keys[a:b], lowest(owner, owners))
                    yield row["part"], row["block"], owner, packed, counts[a:b].tobytes()

        yield from batched(rows(), schema, 500)

    return blocks.select("part", "block", "texts", "flags").mapInArrow(
        run, "part int, block int, owner int, keys binary, counts binary"
    )


def _merged(pdf: pd.DataFrame, owners: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The lists of an owner, their distinct keys and the keys' counts in all training texts."""
    low = lowest(int(pdf["owner"].iloc[0]), owners)
    lists = [unpack(k, low) for k in pdf["keys"]]
    together = np.concatenate(lists)
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]])
    order = np.argsort(together, kind="stable")
    together, counts = together[order], counts[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]]))
    return lists, together[heads], np.add.reduceat(counts, heads)


def _ask(messages: DataFrame, owners: int, answer) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists, keys, counts = _merged(pdf, owners)
        replies = answer(lists, keys, counts)
        out = pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "owner": pdf["owner"], "reply": replies})
        # What the owner knows in all stands in its first row.
        return out.assign(
            distinct=[int((counts > 0).sum())] + [0] * (len(out) - 1), tokens=[int(counts.sum())] + [0] * (len(out) - 1)
        )

    return messages.groupBy("owner").applyInPandas(
        run, "part int, block int, owner int, reply binary, distinct long, tokens long"
    )


def _word_counts(lists: list[np.ndarray], keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    return [counts[np.searchsorted(keys, own)].astype(_TOTAL).tobytes() for own in lists]


def quantiser(total: int, settings: Settings) -> float:
    """Width of a step of -log10 of a probability, so that the rarest pair of ``total`` tokens still has a code."""
    return (np.log10(max(total, 1) / settings.discount) + 1e-9) / (settings.levels - 1)


def _pair_codes(total: int, settings: Settings):
    step = quantiser(total, settings)

    def answer(lists: list[np.ndarray], keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
        seen = counts > 0
        joint = (counts[seen] - settings.discount) / max(total, 1)
        codes = np.round(-np.log10(joint) / step).astype(np.uint8)
        if not len(codes):
            return [np.full(len(own), _ABSENT, np.uint8).tobytes() for own in lists]
        with tempfile.TemporaryFile() as file:
            found = Trie.build(keys[seen], codes).mapped(file).look_up(keys)
        # Each pair is looked up once, however many blocks ask for it.
        return [found[np.searchsorted(keys, own)].tobytes() for own in lists]

    return answer


def _joined(replies: list[dict], kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(r["reply"], kind) for r in replies])


def score_documents(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row; learns from rows where ``train``.

    A text is its words in A-Z lower case and one end. ``base_score`` is its log10
    probability under add-one word frequencies, ``score`` under the interpolated
    bigram model. Every block of texts sends its distinct words, then its distinct
    pairs, with their training counts to the owners of their ranges, and gets the
    words' totals and the pairs' codes from the owner's trie back. Texts never move,
    and neither counts nor the trie pass through one task or the driver: only the
    two totals do.

    A null or empty text is one end. A null ``train`` is false; without training
    rows all counts are 0. Repeated rows count and are scored as often as they
    occur; null ids stay; an empty table gives no rows. ``train`` may use any column
    of ``docs``; no other column is read.
    """
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("flag"),
    )
    blocks = store_blocks(chosen, "lm")
    owners = (blocks.agg(F.sum("n_chars")).first()[0] or 0) // (_WORD_CHARS * OWNER_KEYS) + 1
    words = materialize(_ask(_messages(blocks, "word", owners), owners, _word_counts), "words")
    # Scalars: distinct tokens, tokens, and texts that are learned from.
    distinct, total = (x or 0 for x in words.agg(F.sum("distinct"), F.sum("tokens")).first())
    learned = blocks.agg(F.sum(F.size(F.expr("filter(flags, x -> x)")))).first()[0] or 0
    pairs = materialize(_ask(_messages(blocks, "pair", owners), owners, _pair_codes(total, settings)), "pairs")

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )
    step = quantiser(total, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for row in each_block(batches):
                texts = row["texts"]
                _, word, text = _keys("word", texts)
                counts = _joined(row["words"], _TOTAL)[word].astype(np.float64)
                _, pair, _ = _keys("pair", texts)
                codes = _joined(row["pairs"], np.uint8)[pair].astype(np.float64)
                base = (counts + 1) / (total + distinct + 1)
                # The count of the token before: the previous token's, or the number of training texts.
                context = np.concatenate([[learned], counts[:-1]])
                first = np.concatenate([[True], text[1:] != text[:-1]])
                context[first] = learned
                known = context > 0
                ratio = np.where(codes == _ABSENT, 0.0, 10.0 ** (-codes * step) * total)
                ratio = np.minimum(1.0, ratio / np.maximum(context, 1))
                p = np.where(known, settings.mix * ratio + (1 - settings.mix) * base, base)
                n = len(texts)
                sums = [np.bincount(text, x, n) for x in (np.ones(len(text)), counts > 0, np.log10(base), np.log10(p))]
                for i, doc in enumerate(row["doc_ids"]):
                    yield doc, int(sums[0][i]), int(sums[1][i]), total, sums[2][i], sums[3][i]

        yield from batched(rows(), schema)

    met = bring(bring(blocks, words.drop("distinct", "tokens"), "words"), pairs.drop("distinct", "tokens"), "pairs")
    return met.select("texts", "doc_ids", "words", "pairs").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

