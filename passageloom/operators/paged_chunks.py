"""Chunks of files given as pages, without a row or a task that holds a file.

A chunk's end depends only on where it starts, so the chunks of a file are a walk: from the
first word, each start leads to the next. The walk is cut into blocks of words:

1. Pages become numbers: how many words, whether the first goes on from the page before and
   the last into the next. Running totals over these numbers place every word, and every piece
   of an overlong one, in its file.
2. Pieces move to their block, with as many of the next block as one chunk can need.
3. Each block says, for every place at which a walk can enter it, where that walk leaves it.
4. These links are followed twice as far each time (pointer doubling), so after as many rounds as
   the number of blocks has binary digits the entry into every block is known.
5. Each block walks from its entry and emits its chunks.

The chunks are those of ``functions.words.word_chunks`` on the joined text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageloom.functions.text import clean_page_text
from passageloom.functions.words import chunk_links, window_starts
from passageloom.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, _check
from passageloom.operators.joins import spread_join
from passageloom.operators.ordering import running_total
from passageloom.operators.pages import UNREADABLE
from passageloom.session import materialize

BLOCK = 8192

_FILE = ["file"]


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            yield from zip(*(part.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def readable_pages(pages: DataFrame, file_col: str, page_col: str, text_col: str, mode: str) -> DataFrame:
    """``file, page, text`` of the pages that count: cleaned, none empty.

    ``mode="reference"``: the last unreadable page becomes a marker and pages before it go;
    ``mode="skip"``: unreadable pages go.
    """
    if mode not in ("reference", "skip"):
        raise ValueError(f"unknown mode: {mode}")
    rows = pages.select(F.col(file_col).alias("file"), F.col(page_col).alias("page"), F.col(text_col).alias("text"))
    rows = rows.filter("file is not null")
    if mode == "reference":
        failed = rows.filter("text is null").groupBy("file").agg(F.max("page").alias("failed"))
        rows = spread_join(rows, failed, _FILE, ["page"], "left").filter("failed is null or page >= failed").drop("failed")
        rows = rows.withColumn("text", F.coalesce("text", F.lit(UNREADABLE)))
    return rows.withColumn("text", clean_page_text(F.col("text"))).filter("text != ''")


def _shapes(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Per page: words, whether its ends touch words, the lengths of the first and last, pieces of the others."""
    schema = pa.schema(
        [pages_field(pages, "file"), pages_field(pages, "page"), ("words", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()),
         ("first_len", pa.int64()), ("last_len", pa.int64()), ("inner", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shapes():
            for file, page, text in _rows(batches, "file", "page", "text"):
                words = [len(w) for w in text.split()]
                inner = sum(1 if n <= size else len(window_starts(n, size, overlap)) for n in words[1:-1])
                first, last = (words[0], words[-1]) if words else (0, 0)
                yield file, page, len(words), not text[0].isspace(), not text[-1].isspace(), first, last, inner

        yield from _batches(shapes(), schema, 5000)

    kinds = dict(pages.dtypes)
    ddl = f"file {kinds['file']}, page {kinds['page']}, words long, left boolean, right boolean, first_len long, last_len long, inner long"
    return pages.mapInArrow(run, ddl)


def pages_field(pages: DataFrame, name: str) -> pa.Field:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    kind = dict(pages.dtypes)[name]
    if kind not in kinds:
        raise ValueError(f"{name} has to be a string or a whole number, not {kind}")
    return pa.field(name, kinds[kind])


def _pieces(length: Column, size: int, overlap: int) -> Column:
    """Into how many pieces a word of ``length`` is cut."""
    return F.when(length <= size, 1).otherwise(F.ceil((length - overlap) / (size - overlap))).cast("long")


def _places(shapes: DataFrame, size: int, overlap: int) -> DataFrame:
    """Adds ``glued``, ``before`` (pieces of the file before the page's own) and, of the words at the page's
    two ends, their whole lengths and how much of the first lies on earlier pages."""
    one = shapes.withColumn("_one", F.lit(1))
    shapes = materialize(running_total(one, _FILE, ["page"], "_one", "at").drop("_one"), "pages")
    earlier = shapes.select("file", (F.col("at") + 1).alias("at"), F.col("right").alias("_right"))
    glued = (F.col("left") & F.coalesce("_right", F.lit(False))).cast("int")
    linked = shapes.join(earlier, ["file", "at"], "left").withColumn("glued", glued).drop("_right")
    starts = linked.withColumn("starts", F.col("words") - F.col("glued"))
    numbered = running_total(starts, _FILE, ["at"], "starts", "_words").withColumn("first_word", F.col("_words") - F.col("glued"))
    numbered = materialize(numbered.withColumn("last_word", F.col("first_word") + F.col("words") - 1).drop("_words"), "words")
    # The words at the ends of pages, which can go on over any number of pages.
    firsts = numbered.filter("words > 0").select("file", F.col("first_word").alias("word"), "at", F.col("first_len").alias("len"))
    lasts = numbered.filter("words > 1").select("file", F.col("last_word").alias("word"), "at", F.col("last_len").alias("len"))
    ends = materialize(running_total(firsts.unionByName(lasts), ["file", "word"], ["at"], "len", "offset"), "ends")
    whole = ends.groupBy("file", "word").agg(F.sum("len").alias("whole"))
    ends = materialize(spread_join(ends, whole, ["file", "word"], ["at"]).select("file", "word", "at", "offset", "whole"), "whole")
    first = ends.select("file", "at", F.col("word").alias("first_word"), "offset", F.col("whole").alias("first_whole"))
    last = ends.select("file", "at", F.col("word").alias("last_word"), F.col("whole").alias("last_whole"))
    placed = numbered.join(first, ["file", "at", "first_word"], "left").join(last, ["file", "at", "last_word"], "left")
    own_first = F.when((F.col("words") > 1) & (F.col("glued") == 0), _pieces(F.col("first_whole"), size, overlap)).otherwise(0)
    own_last = F.when(F.col("starts") > 0, _pieces(F.col("last_whole"), size, overlap)).otherwise(0)
    placed = placed.withColumn("own", own_first + F.col("inner") + own_last)
    return running_total(placed, _FILE, ["at"], "own", "before").select(
        "file", "page", "glued", "before", "offset", "first_whole", "last_whole"
    )


def _in_blocks(pages: DataFrame, places: DataFrame, size: int, overlap: int, block: int, halo: int) -> DataFrame:
    """``file, block, piece, at, texts``: runs of pieces from number ``piece`` on, or a part of one piece that begins at ``at``."""
    file = pages_field(pages, "file")
    schema = pa.schema([file, ("block", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("texts", pa.list_(pa.string()))])
    step = size - overlap

    def count(length: int) -> int:
        return 1 if length <= size else len(window_starts(length, size, overlap))

    def parts(text: str, offset: int, whole: int, piece: int) -> Iterator[tuple[int, int, str]]:
        """The parts of a word's pieces that lie in ``text``, which begins at ``offset`` of the word."""
        if whole <= size:
            yield piece, offset, text
            return
        end = offset + len(text)
        for j in range(max(0, -(-(offset - size + 1) // step)), min(count(whole), (end - 1) // step + 1)):
            a, b = max(offset, j * step), min(end, j * step + size)
            if a < b:
                yield piece + j, a - j * step, text[a - offset : b - offset]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed():
            for file, text, glued, piece, offset, first_whole, last_whole in _rows(
                batches, "file", "text", "glued", "before", "offset", "first_whole", "last_whole"
            ):
                words, held = text.split(), []
                for i, word in enumerate(words):
                    first, last = i == 0, i == len(words) - 1
                    whole = first_whole if first else last_whole if last else len(word)
                    if first and glued:
                        piece -= count(whole)
                    alone = len(word) == whole <= size
                    if held and (not alone or piece % block in (0, halo)):
                        yield from in_blocks(file, piece - len(held), 0, held)
                        held = []
                    if alone:
                        held.append(word)
                    else:
                        for number, at, part in parts(word, offset if first else 0, whole, piece):
                            yield from in_blocks(file, number, at, [part])
                    piece += count(whole)
                if held:
                    yield from in_blocks(file, piece - len(held), 0, held)

        def in_blocks(file, piece, at, texts):
            yield file, piece // block, piece, at, texts
            if piece >= block and piece % block < halo:
                yield file, piece // block - 1, piece, at, texts

        yield from _batches(placed(), schema, 500)

    joined = pages.join(places, ["file", "page"])
    return joined.mapInArrow(run, f"file {dict(pages.dtypes)['file']}, block long, piece long, at long, texts array<string>")


def _assembled(parts: DataFrame) -> DataFrame:
    """``file, block, pieces``: the pieces of a block and of the start of the next, in order."""
    kind = dict(parts.dtypes)["file"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[tuple[int, str]]] = {}
        for piece, at, texts in zip(pdf["piece"], pdf["at"], pdf["texts"]):
            for i, text in enumerate(texts):
                found.setdefault(piece + i, []).append((at, text))
        pieces = ["".join(t for _, t in sorted(found[p])) for p in sorted(found)]
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "block": [pdf["block"].iloc[0]], "pieces": [pieces]})

    return parts.groupBy("file", "block").applyInPandas(run, f"file {kind}, block long, pieces array<string>")


def _links(blocks: DataFrame, size: int, overlap: int, block: int, halo: int) -> DataFrame:
    """``file, block, entry, exit, chunks``: where a walk that enters at ``entry`` enters the next block, after how many chunks."""
    schema = pa.schema([pages_field(blocks, "file"), *((n, pa.int64()) for n in ("block", "entry", "exit", "chunks"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for file, number, pieces in _rows(batches, "file", "block", "pieces"):
                if len(pieces) <= block:
                    continue  # the last block: no walk leaves it
                follow = chunk_links([len(p) for p in pieces], size, overlap)
                walks = [(i, 0) for i in range(len(pieces) + 1)]
                for i in range(block - 1, -1, -1):
                    out, chunks = walks[follow[i][1]]
                    walks[i] = out, chunks + 1
                for entry in range(halo if number else 1):
                    out, chunks = walks[entry]
                    if out < len(pieces):
                        yield file, number, number * block + entry, number * block + out, chunks

        yield from _batches(links(), schema, 20_000)

    kind = dict(blocks.dtypes)["file"]
    return blocks.mapInArrow(run, f"file {kind}, block long, entry long, exit long, chunks long")


def _entries(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """``file, block, entry, chunk_no``: where the walk of each file enters each of its blocks, and its chunks before that."""
    entries = blocks.filter("block = 0").select("file", "block", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("chunk_no"))
    most = links.agg(F.max("block")).first()[0]
    jumps = []
    while most is not None and (1 << len(jumps)) <= most + 1:
        if not jumps:
            jumps.append(links)
            continue
        far = 1 << (len(jumps) - 1)
        half = jumps[-1]
        then = half.select("file", (F.col("block") - far).alias("block"), F.col("entry").alias("exit"), F.col("exit").alias("_exit"), F.col("chunks").alias("_chunks"))
        both = half.join(then, ["file", "block", "exit"])
        jumps.append(materialize(both.select("file", "block", "entry", F.col("_exit").alias("exit"), (F.col("chunks") + F.col("_chunks")).alias("chunks")), "jumps"))
    for i in range(len(jumps) - 1, -1, -1):
        ahead = entries.join(jumps[i], ["file", "block", "entry"]).select(
            "file", (F.col("block") + (1 << i)).alias("block"), F.col("exit").alias("entry"), (F.col("chunk_no") + F.col("chunks")).alias("chunk_no")
        )
        entries = materialize(entries.unionByName(ahead), "entries")
    return entries


def chunk_pages(
    pages: DataFrame,
    file_col: str = "relative_path",
    page_col: str = "page_no",
    text_col: str = "text",
    mode: str = "reference",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    block: int = BLOCK,
) -> DataFrame:
    """``(file_col, chunk_no, chunk)``: the word chunks of each file's assembled text, straight from its pages.

    The same rows as ``chunk_words`` on ``assemble_pages``, for files of any size: what a task holds is
    a page or a block. Files and pages are strings or whole numbers, ``(file, page)`` is unique.
    Files without words, and pages without a file, give no rows.
    """
    _check(size, overlap)
    halo = size // 2 + 2  # more pieces than a chunk can have
    if block < halo:
        raise ValueError(f"a block needs at least {halo} pieces")
    kept = materialize(readable_pages(pages, file_col, page_col, text_col, mode), "pages")
    places = _places(_shapes(kept, size, overlap), size, overlap)
    blocks = materialize(_assembled(_in_blocks(kept, places, size, overlap, block, halo)), "blocks")
    links = materialize(_links(blocks, size, overlap, block, halo), "links")
    entries = _entries(blocks, links)
    schema = pa.schema([pages_field(blocks, "file"), ("chunk_no", pa.int32()), ("chunk", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks():
            for file, number, pieces, entry, chunk_no in _rows(batches, "file", "block", "pieces", "entry", "chunk_no"):
                follow = chunk_links([len(p) for p in pieces], size, overlap)
                at = entry - number * block
                while at < min(block, len(pieces)):
                    final, following = follow[at]
                    yield file, chunk_no, " ".join(pieces[at : final + 1])
                    at, chunk_no = following, chunk_no + 1

        yield from _batches(chunks(), schema, 1000)

    kind = dict(blocks.dtypes)["file"]
    out = blocks.join(entries, ["file", "block"]).mapInArrow(run, f"file {kind}, chunk_no int, chunk string")
    return out.withColumnRenamed("file", file_col)
