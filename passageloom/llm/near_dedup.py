"""Near duplicates: MinHash signatures, a multi-index Hamming join, and links confirmed on whole shingle sets.

A signature has ``positions`` values of 16 bits. Two documents at the similarity
threshold differ in about ``positions * (1 - threshold)`` of them; ``distance``
lies over four standard deviations above. By pigeonhole, signatures within
``distance`` agree in one of ``chunks`` chunks up to ``errors`` positions; each
chunk is therefore written once for every choice of positions that may be wrong,
with these left out. All pairs within the distance share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.common import batched, rows_of, texts
from passageloom.llm.components import components
from passageloom.llm.exchange import pack, unpack
from passageloom.llm.parts import bring_digits, numbered, part_buckets, placed_by_part, store_documents, store_parts, unpack_documents
from passageloom.llm.words import hash_words, mix, ngrams
from passageloom.operators.joins import spread_join
from passageloom.session import materialize

_BATCH_CHARS = 1 << 20
# Of a tile's work: values in a range, cells of a dense block, rows of the matrix at once.
_RANGE = 1 << 20
_CELLS = 1 << 22
_ROWS = 256


@dataclass(frozen=True)
class Settings:
    percent: int = 80
    words: int = 5
    positions: int = 64
    distance: int = 27
    errors: int = 1
    tile: int = 2048

    @property
    def chunks(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.positions), -(-(self.distance + 1) // (self.errors + 1)))


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted; a shorter text is one shingle, one without words none."""
    if not len(hashes):
        return hashes
    return np.unique(ngrams(hashes, min(words, len(hashes))))


def signatures(sets: list[np.ndarray], positions: int) -> np.ndarray:
    """One row of 16-bit minima per set; no set is empty."""
    random = np.random.Generator(np.random.PCG64(5))
    flips = random.integers(0, 1 << 32, positions, dtype=np.uint32)
    factors = random.integers(0, 1 << 32, positions, dtype=np.uint32) | np.uint32(1)
    values = np.concatenate(sets)
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), positions), np.uint16)
    for k in range(positions):
        least = np.minimum.reduceat((values ^ flips[k]) * factors[k], starts)
        out[:, k] = mix(least.astype(np.uint64)) >> np.uint64(48)
    return out


def masked_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    """Keys of signatures, one row each: every chunk with every choice of ``errors`` positions left out."""
    columns, number = [], 0
    for chunk in settings.chunks:
        for left_out in combinations(range(len(chunk)), min(settings.errors, len(chunk) - 1)):
            number += 1
            key = np.full(len(signature), number, np.uint64)
            for place in np.delete(chunk, left_out):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, place].astype(np.uint64))
            columns.append(key)
    return np.stack(columns, axis=1)


def _describe(rows: DataFrame, settings: Settings) -> DataFrame:
    schema = pa.schema(
        [("part", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()),
         ("same", pa.binary()), ("signature", pa.binary()), ("codes", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def described(held: list[tuple]) -> Iterator[tuple]:
            hashes, starts = hash_words([r[3] for r in held])
            sets = [shingles(hashes[a:b], settings.words) for a, b in zip(starts, starts[1:])]
            full = [s for s in sets if len(s)]
            found = iter(signatures(full, settings.positions) if full else ())
            for (part, pos, doc, _), own in zip(held, sets):
                if not len(own):
                    yield part, pos, doc, 0, None, None, None
                    continue
                # Two 64-bit sums over the set: equal sets have equal ones.
                same = np.array([mix(own).sum(), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
                yield part, pos, doc, len(own), same.tobytes(), next(found).tobytes(), pack(own, 0)

        def all_rows():
            held, size = [], 0
            for row in rows_of(batches, "part", "pos", "doc_id", "text"):
                held.append(row)
                size += len(row[3]) + 1
                if size >= _BATCH_CHARS:
                    yield from described(held)
                    held, size = [], 0
            if held:
                yield from described(held)

        yield from batched(all_rows(), schema, 500)

    return rows.mapInArrow(
        run, "part int, pos long, doc_id long, n_shingles long, same binary, signature binary, codes binary"
    )


def _keys(classes: DataFrame, settings: Settings) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000).to_pydict()
                own = np.stack([np.frombuffer(s, np.uint16) for s in part["signature"]])
                keys = masked_keys(own, settings)
                nodes = np.repeat(np.array(part["node"], np.int64), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], schema=schema)

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _meetings(keys: DataFrame) -> DataFrame:
    """``u, v``: every node with the first node of each of its keys; rows of a key stream past, none is held."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            if not new[0]:
                heads = np.where(np.cumsum(new) == 0, first, n[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))])
            else:
                heads = n[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            key, first = int(k[-1]), int(heads[-1])
            met = n != heads
            yield pa.RecordBatch.from_arrays([pa.array(n[met]), pa.array(heads[met])], schema=schema)

    ordered = keys.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def _shared_columns(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Owners and columns of the values that several of the sorted ``sets`` hold, a range of values at a time."""
    pieces = sum(map(len, sets)) // _RANGE + 1
    bounds = [(i << 64) // pieces for i in range(1, pieces)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(bounds, np.uint64)), [len(s)]]) for s in sets]
    for i in range(pieces):
        own = [s[c[i] : c[i + 1]] for s, c in zip(sets, cuts)]
        values = np.concatenate(own)
        order = np.argsort(values, kind="stable")
        values = values[order]
        owner = np.repeat(np.arange(len(own), dtype=np.int32), [len(s) for s in own])[order]
        same = np.zeros(len(values), bool)
        same[1:] = values[1:] == values[:-1]
        use = same.copy()
        use[:-1] |= same[1:]
        yield owner[use], np.cumsum(~same[use]) - 1


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values two of the sorted ``sets`` share: a matrix of which the upper triangle is filled."""
    n = len(sets)
    shared = np.zeros((n, n), np.float32)
    width = max(1, _CELLS // n)
    for owner, column in _shared_columns(sets):
        total = int(column[-1]) + 1 if len(column) else 0
        for begin in range(0, total, width):
            a, b = np.searchsorted(column, [begin, begin + width])
            block = np.zeros((n, min(width, total - begin)), np.float32)
            block[owner[a:b], column[a:b] - begin] = 1
            for row in range(0, n, _ROWS):
                shared[row : row + _ROWS, row:] += block[row : row + _ROWS] @ block[row:].T
    return shared


def confirmed(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """What links of similarity ``percent`` or more connect: every node but the least of each part, with the least.

    Beside the sorted ``sets``, memory is five bytes for each cell of the matrix of sets and a bounded rest:
    ranges of values and blocks of rows are worked off in turn.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = _shared_counts(sets)
    linked = np.zeros((n, n), bool)
    for row in range(0, n, _ROWS):
        own = slice(row, row + _ROWS)
        both = shared[own, row:].astype(np.int64)
        linked[own, row:] = (100 + percent) * both >= percent * (sizes[own, None] + sizes[None, row:])
    del shared
    linked |= linked.T
    np.fill_diagonal(linked, False)
    stars, waiting = [], np.ones(n, bool)
    for first in np.argsort(nodes):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            found = np.flatnonzero(linked[queue.pop()] & waiting)
            waiting[found] = False
            queue.extend(found)
            stars += [(nodes[other], nodes[first]) for other in found]
    return stars


def _blocks(met: DataFrame, settings: Settings) -> DataFrame:
    """``node, part, pos, component, block, blocks`` of candidates: a group's nodes dealt into blocks of about ``tile``."""
    sizes = met.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("blocks", F.floor(F.col("size") / settings.tile).cast("int") + 1).drop("size")
    return spread_join(met, sizes, ["component"], ["node"]).select(
        "node",
        F.shiftright("node", 33).cast("int").alias("part"),
        F.col("node").bitwiseAND((1 << 33) - 1).alias("pos"),
        "component",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        "blocks",
    )


def _links(placed: DataFrame, settings: Settings) -> DataFrame:
    """``u, v``: links inside groups of candidates, compared tile by tile.

    Every pair of a group's blocks is a tile, so a tile's memory doesn't grow with its group, and sets
    move once, to their tiles. A tile gives one link per node at most, never all its pairs.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiled = placed.withColumn("other", other).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "codes"
    )
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, nodes, sets = None, [], []
            for component, i, j, node, codes in rows_of(batches, "component", "i", "j", "node", "codes"):
                if (component, i, j) != at:
                    if len(nodes) > 1:
                        yield from confirmed(nodes, sets, settings.percent)
                    at, nodes, sets = (component, i, j), [], []
                nodes.append(node)
                sets.append(unpack(codes, 0))
            if len(nodes) > 1:
                yield from confirmed(nodes, sets, settings.percent)

        yield from batched(rows(), schema)

    tile = ["component", "i", "j"]
    return tiled.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "u long, v long")


def group_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    settings: Settings = Settings(),
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    A-Z are lower-cased; a document's set is its distinct shingles of ``words``
    words, or all its words as one if they are fewer. Documents are linked if
    their sets share at least ``percent`` of their union. ``component_id`` is the
    least id that links reach.

    Shingles are equal if their 64-bit hashes are. Among ``n`` distinct shingles of
    one text ``n * n / 2**65`` collisions are expected (3e-8 for a million, 3e-6 for
    ten million), each making ``n_shingles`` one too small; between two sets of
    ``n`` and ``m``, ``n * m / 2**64``, which matters only to a pair at the threshold.

    Equal sets are one node, so copies cost one row each. Only rows that meet
    another in a key have their sets moved. Memory follows a batch of texts, or a
    tile, never a group.

    A null, empty or blank text has no shingles and is linked with nothing: its
    ``component_id`` is its own id. A null id never names a component unless all of
    its ids are null. Rows with equal ids are separate and all called kept if their
    id names the component. An empty table gives no rows; other columns are not read.
    """
    out = _grouped(numbered(texts(docs, id_col, text_col)), settings)
    return out.select("doc_id", "n_shingles", "component_id", _kept().alias("kept"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns; cases as in ``group_near_copies``."""
    rows = store_documents(docs, id_col, text_col, "documents")
    read = rows.withColumn("text", F.coalesce("text", F.lit(""))).select("part", "pos", "doc_id", "text")
    digits = _grouped(read, settings).select("part", "pos", F.when(_kept(), "1").otherwise("0").alias("digit"))
    return unpack_documents(bring_digits(rows, digits, "_kept").filter("_kept = '1'"), docs, text_col)


def _kept():
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def _grouped(rows: DataFrame, settings: Settings) -> DataFrame:
    """``part, pos, doc_id, n_shingles, component_id`` for ``part, pos, doc_id, text``."""
    described = store_parts(_describe(rows.select("part", "pos", "doc_id", "text"), settings), "shingles")
    described = described.withColumn("node", F.shiftleft(F.col("part").cast("long"), 33) + F.col("pos"))

    filled = described.filter("n_shingles > 0")
    classes = materialize(
        filled.groupBy("same").agg(
            F.min("node").alias("node"), F.min("doc_id").alias("least_id"), F.max("signature").alias("signature"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "classes",
    )
    meetings = materialize(_meetings(_keys(classes, settings)), "meetings")
    met = materialize(components(meetings), "met")

    placed = materialize(_blocks(met, settings), "placed")
    # The sets stay in their parts and the places come to them.
    buckets = part_buckets(described.sparkSession)
    with placed_by_part(described.sparkSession):
        sets = filled.select("part", "pos", "codes").join(placed.repartition(buckets, "part").hint("shuffle_hash"), ["part", "pos"])
        links = materialize(_links(sets, settings), "links")
    linked = materialize(components(links).join(classes.select("node", "same", "least_id"), "node"), "linked")
    ids = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = spread_join(linked, ids, ["component"], ["node"]).select("same", "component_id")
    copied = classes.filter("copies > 1").join(linked, "node", "left_anti")
    named = materialize(joined.unionByName(copied.select("same", F.col("least_id").alias("component_id"))), "named")
    # Of the other rows, each is a component of its own.
    columns = ["part", "pos", "doc_id", "n_shingles"]
    named = named.withColumn("named", F.lit(True))
    inside = spread_join(filled.select(*columns, "same"), named, ["same"], ["part", "pos"], how="left")
    own = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    inside = inside.withColumn("component_id", own)
    outside = described.filter("n_shingles = 0").select(*columns, F.col("doc_id").alias("component_id"))
    return inside.select(*columns, "component_id").unionByName(outside)
