"""Removal of long byte strings that occur more than once, by a distributed difference-cover algorithm.

Suffixes are compared by their first ``length`` bytes only. Those at positions
whose residue modulo ``period`` lies in a difference cover are the sample (the
classic algorithm has the period 3). A sampled suffix gets a name, the hash of
as many bytes as two equal strings still share from any common sampled place
on; the owner of a range of names has them sorted and compares neighbours. For
any two positions the cover has a shift of less than ``period`` that takes both
into the sample, so a string that repeats holds a sampled name that repeats.
Only suffixes that reach such a name are merged in: their prefixes of the whole
length are named, sorted by their owners and compared with their neighbours.

The recursion of the full algorithm orders suffixes beyond any bound. It isn't
needed here: names of a bounded prefix already tell equal from different.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.blocks import bring, each_block, store_blocks
from passageloom.llm.common import batched
from passageloom.llm.exchange import ask_owners, lowest, mark_duplicates, pack, split
from passageloom.llm.words import mix, powers, prefix_sums
from passageloom.session import materialize

LENGTH = 400
# The cover is a Singer difference set: modulo p*p + p + 1 it has p + 1 residues.
PRIME = 17
OWNER_BYTES = 1 << 23
_SEGMENT = 1 << 20
# Sample names may be short: equal names of different strings only cost work, they decide nothing.
_DROPPED = 16


@lru_cache
def difference_cover(p: int = PRIME) -> tuple[int, np.ndarray]:
    """A period and residues such that every difference modulo the period is one of two residues.

    The powers of a suitable element of the field of ``p**3`` elements run through
    all points of a projective plane; those on one line are the residues.
    """
    period = p * p + p + 1
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                point, residues = (1, 0, 0), []
                for i in range(period):
                    if point[2] == 0:
                        residues.append(i)
                    x, y, z = point
                    point = (c * z % p, (x + b * z) % p, (y + a * z) % p)
                found = np.array(residues)
                if len(found) == p + 1 and len(np.unique((found[:, None] - found) % period)) == period:
                    return period, found
    raise ValueError(f"no difference set for {p}")


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of ``data[i : i + length]`` for the sorted places ``at``; memory follows a segment."""
    out = np.empty(len(at), np.uint64)
    done = 0
    while done < len(at):
        first = int(at[done])
        until = int(np.searchsorted(at, first + _SEGMENT))
        own = at[done:until] - first
        part = data[first : int(at[until - 1]) + length]
        sums = prefix_sums(part)
        out[done:until] = mix((sums[own + length] - sums[own]) * powers(len(part))[1][own])
        done = until
    return out


class Block:
    """The bytes of some texts, one after the other."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def sampled(self, length: int, p: int) -> tuple[np.ndarray, int]:
        """Sampled places with room for a name, and the length of a name."""
        period, residues = difference_cover(p)
        name = length - period + 1
        found = []
        for start, size in zip(self.starts, self.sizes):
            if size >= length:
                room = int(size) - name
                places = (np.arange(0, room + 1, period)[:, None] + residues).ravel()
                found.append(places[places <= room] + start)
        return (np.concatenate(found) if found else np.empty(0, np.int64)), name

    def reaching(self, places: np.ndarray, length: int, p: int) -> np.ndarray:
        """Places of whole strings that hold one of the sampled ``places`` within the period."""
        if not len(places):
            return places
        period, _ = difference_cover(p)
        text = np.searchsorted(self.ends, places, side="right")
        begin = np.maximum(places - period + 1, self.starts[text])
        end = np.minimum(places, self.ends[text] - length) + 1
        return np.flatnonzero(_cover(begin, np.maximum(end, begin), len(self.data)))


def _cover(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


class _Names:
    """Distinct names of a block's places and what is known of them."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.keys, self.where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.again = counts > 1

    def messages(self, owners: int, dropped: int) -> Iterator[tuple[int, bytes]]:
        for owner, a, b in split(self.keys << np.uint64(dropped), owners):
            yield owner, pack(self.keys[a:b], lowest(owner, owners) >> dropped)

    def repeated(self, replies: list[dict] | None, owners: int, dropped: int) -> np.ndarray:
        """Which places have a name that occurs elsewhere too."""
        bits = {r["owner"]: r["reply"] for r in replies or []}
        again = self.again.copy()
        for owner, a, b in split(self.keys << np.uint64(dropped), owners):
            again[a:b] |= np.unpackbits(np.frombuffer(bits[owner], np.uint8), count=b - a).astype(bool)
        return again[self.where]


def _sample_names(block: Block, length: int, p: int) -> tuple[np.ndarray, _Names]:
    places, size = block.sampled(length, p)
    return places, _Names(window_hashes(block.data, places, size) >> np.uint64(_DROPPED))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, p: int = PRIME,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row; with ``with_text`` the bytes that are kept.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another. Strings are judged as the texts
    came in and don't cross texts. Whole texts are stored once in blocks; after
    that only compressed names and bitmaps move. A block sends a name once, so a
    string that most texts share is one name per block and owner.

    A null or empty text has no bytes. Texts shorter than ``length`` stay as they
    are. Null ids and repeated rows stay and count as texts of their own; an empty
    table gives no rows; other columns are not read. Equality is that of 64-bit
    hashes: among ``n`` different strings, ``n * n / 2**65`` are expected to be
    taken for equal, fewer than one in a thousand runs at a hundred million.
    """
    period, _ = difference_cover(p)
    if length <= period:
        raise ValueError(f"length must be over {period}; choose a smaller p")
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(False).alias("flag")
    )
    blocks = store_blocks(chosen, "suffixes").drop("flags")
    owners = (blocks.agg(F.sum("n_chars")).first()[0] or 0) // OWNER_BYTES + 1
    message = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("owner", pa.int32()), ("keys", pa.binary())])
    ddl = "part int, block int, owner int, keys binary"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for row in each_block(batches):
                _, names = _sample_names(Block(row["texts"]), length, p)
                for owner, keys in names.messages(owners, _DROPPED):
                    yield row["part"], row["block"], owner, keys

        yield from batched(rows(), message, 500)

    def wholes(row: dict) -> tuple[Block, np.ndarray, _Names]:
        block = Block(row["texts"])
        places, names = _sample_names(block, length, p)
        whole = block.reaching(places[names.repeated(row["sampled"], owners, _DROPPED)], length, p)
        return block, whole, _Names(window_hashes(block.data, whole, length))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for row in each_block(batches):
                for owner, keys in wholes(row)[2].messages(owners, 0):
                    yield row["part"], row["block"], owner, keys

        yield from batched(rows(), message, 500)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for row in each_block(batches):
                block, whole, names = wholes(row)
                begin = whole[names.repeated(row["merged"], owners, 0)]
                gone = _cover(begin, begin + length, len(block.data))
                for doc, start, end in zip(row["doc_ids"], block.starts, block.ends):
                    own = gone[start:end]
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(len(own) > 0 and own[0])
                    kept = block.data[start:end][~own].tobytes()
                    out = (doc, len(own), int(own.sum()), spans, hashlib.sha256(kept).hexdigest())
                    yield (*out, kept) if with_text else out

        yield from batched(rows(), schema, 1000)

    asked = blocks.select("part", "block", "texts").mapInArrow(sample, ddl)
    sampled = materialize(ask_owners(asked, owners, mark_duplicates, _DROPPED), "sampled")
    known = bring(blocks, sampled, "sampled")
    asked = known.select("part", "block", "texts", "sampled").mapInArrow(merge, ddl)
    merged = materialize(ask_owners(asked, owners, mark_duplicates), "merged")
    return bring(known, merged, "merged").select("doc_ids", "texts", "sampled", "merged").mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text,
    )
