"""Spelling variants: words one inserted, deleted or replaced letter apart, from pairs of trie nodes.

The nodes of the trie of all words, and of the trie of all reversed words, are numbered. Then
every split of a word is a pair of numbers: the node of what comes before, the node of what
comes after. A word of ``n`` letters enters the dictionary once for each letter, with the
letter skipped, and once for each place between letters. Two words with a letter
skipped meet in a pair if they differ in that letter alone, and a word with a letter skipped meets
the word that lacks it. No word is compared with another, and a pair holds
at most one whole word and one word for each letter of the alphabet, however common it is.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageloom.llm.common import batched, rows_of
from passageloom.operators.joins import spread_join
from passageloom.operators.ordering import number_rows
from passageloom.session import materialize

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
LETTERS = "a-zÀ-ÿ"

_NODE_BITS = 40  # nodes of one task; the rest of a number is the task
_WHOLE, _LATER, _FIRST = 0, 1, 2  # nothing skipped; a letter; the first letter of a run of equal ones


# ---- words -----------------------------------------------------------------------------------


def damaged(doc_id: Column, run: Column, every: int = 199) -> Column:
    """``run`` without the letter that its checksum with the id chooses, if ``every`` divides the checksum."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (checksum % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))
    return F.when(checksum % every == 0, shorter).otherwise(run)


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    damage: bool = False,
) -> DataFrame:
    """``word, n``: runs of letters of the whole texts, A-Z lower-cased, that are long and frequent enough.

    Only counts of distinct words leave a task. A null text has no words, a null id counts as
    an empty one in the checksums of ``damage``.
    """
    lowered = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    # Damage never makes a run longer, so shorter runs needn't be taken out of the text.
    runs = F.regexp_extract_all(lowered, F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run"))
    word = damaged(F.col("doc_id"), F.col("run")) if damage else F.col("run")
    return (
        rows.select(word.alias("word")).filter(F.length("word") >= min_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    )


# ---- numbered trie nodes ---------------------------------------------------------------------


def trie_nodes(words: DataFrame, key: str, name: str) -> DataFrame:
    """``rank, nodes`` of distinct words (``rank`` and the column ``key``): the numbers of the nodes of a key's prefixes.

    In sorted order, the prefixes that a key shares with the one before it are nodes that exist
    already; a stack of the current path is all that a task keeps. A task numbers its
    nodes on its own. Only the path of its first key can belong to nodes of earlier tasks: these
    numbers are replaced by a table of one path per range partition.
    """
    spark = words.sparkSession
    schema = pa.schema([("rank", pa.int64()), ("key", pa.string()), ("nodes", pa.list_(pa.int64())), ("slice", pa.int64()), ("edge", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def numbered():
            path: list[int] = []
            new, held = task << _NODE_BITS, None
            for rank, word in rows_of(batches, "rank", "key"):
                shared = len(commonprefix([held[1], word])) + 1 if held else 0
                fresh = len(word) + 1 - shared
                path = path[:shared] + list(range(new, new + fresh))
                new += fresh
                if held:
                    yield held
                held = (rank, word, path, task, 0 if held else 1)
            if held:
                yield (*held[:4], held[4] + 2)

        yield from batched(numbered(), schema)

    sorted_keys = words.select("rank", F.col(key).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    rows = materialize(sorted_keys.mapInArrow(run, "rank long, key string, nodes array<long>, slice long, edge int"), name)
    earlier = spark.createDataFrame(_earlier_paths(rows), "slice long, earlier array<long>")
    local = lambda node: node.bitwiseAND(F.lit((1 << _NODE_BITS) - 1)).cast("int")
    # A task's first key got the first numbers, from 0, so that a number's place in its path is the number.
    nodes = F.transform("nodes", lambda x: F.coalesce(F.get(F.col("earlier"), local(x)), x))
    same = F.when(F.size("earlier") > 0, nodes).otherwise(F.col("nodes"))
    return rows.join(F.broadcast(earlier), "slice").select("rank", same.alias("nodes"))


def _earlier_paths(rows: DataFrame) -> list[tuple[int, list[int]]]:
    """Per slice, the numbers that the path of its first key shares with the key before; from two keys per slice."""
    borders = rows.filter("edge > 0").orderBy("slice", "key").collect()
    paths, last_key, last_path, current = {}, "", [], None
    for row in borders:
        if row.slice not in paths:
            if current is not None:
                last_key, last_path = current
            shared = len(commonprefix([last_key, row.key])) + 1 if last_path else 0
            paths[row.slice] = last_path[:shared]
        own = paths[row.slice]
        mask = (1 << _NODE_BITS) - 1
        current = row.key, [own[x & mask] if (x & mask) < len(own) else x for x in row.nodes]
    return list(paths.items())


# ---- joins -----------------------------------------------------------------------------------


def _merged(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Both by ``rank``. A table with a row per word stays out of the driver, however small its file is: a broadcast
    is chosen by the size of the compressed file, and takes many times that there."""
    return left.join(right.hint("merge"), "rank", how)


# ---- pairs -----------------------------------------------------------------------------------


def split_pairs(words: DataFrame) -> DataFrame:
    """``before, after, rank, kind`` for every letter and every place between letters of ``words`` (``rank, word``)."""
    forward = trie_nodes(words, "word", "forward")
    backward = trie_nodes(words.withColumn("reversed", F.reverse("word")), "reversed", "backward")
    both = _merged(_merged(forward.withColumnRenamed("nodes", "f"), backward.withColumnRenamed("nodes", "b")), words)
    schema = pa.schema([("before", pa.int64()), ("after", pa.int64()), ("rank", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for rank, word, f, b in rows_of(batches, "rank", "word", "f", "b"):
                n = len(word)
                for i in range(n):
                    yield f[i], b[n - i - 1], rank, _LATER if i and word[i - 1] == word[i] else _FIRST
                    yield f[i], b[n - i], rank, _WHOLE
                yield f[n], b[0], rank, _WHOLE

        yield from batched(pairs(), schema, 20_000)

    return both.mapInArrow(run, "before long, after long, rank long, kind int")


def neighbours(pairs: DataFrame) -> DataFrame:
    """``rank, n_near, best``: how many words are near a word, and the least rank among them.

    Words that differ in one letter meet once. A word and the one that lacks a letter meet for
    each letter of the run it belongs to; only the first of the run counts. What a word needs to know
    of a pair are counts and the two least ranks, so no two words are ever put side by side.
    """
    here = Window.partitionBy("before", "after")
    skipped, first = F.col("kind") != _WHOLE, F.col("kind") == _FIRST
    least = F.min(F.when(skipped, F.col("rank"))).over(here)
    met = pairs.withColumns(
        {
            "_all": F.count(F.lit(1)).over(here),
            "_skipped": F.count(F.when(skipped, 1)).over(here),
            "_firsts": F.count(F.when(first, 1)).over(here),
            "_least": least,
            "_least_first": F.min(F.when(first, F.col("rank"))).over(here),
            "_whole": F.max(F.when(~skipped, F.col("rank"))).over(here),
        }
    ).filter("_all > 1")
    met = met.withColumn("_second", F.min(F.when(skipped & (F.col("rank") != F.col("_least")), F.col("rank"))).over(here))
    lacking = F.when(first, F.col("_whole"))
    found = met.select(
        "rank",
        F.when(skipped, F.col("_skipped") - 1 + F.when(lacking.isNotNull(), 1).otherwise(0)).otherwise(F.col("_firsts")).alias("n"),
        F.when(skipped, F.least(F.when(F.col("rank") == F.col("_least"), F.col("_second")).otherwise(F.col("_least")), lacking))
        .otherwise(F.col("_least_first")).alias("best"),
    )
    return found.filter("n > 0").groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """``rank, root`` of every word with a form: links (``rank, form``) followed to their ends, twice as far each time.

    A form is ``ratio`` times as frequent as its word, so the longest chain follows from the largest count.
    """
    steps, reached = 1, MIN_COUNT
    while reached <= most:
        steps, reached = steps + 1, reached * ratio
    far = materialize(links.select("rank", F.col("form").alias("root")), "links")
    reach = 1
    while reach < steps:
        ahead = far.select(F.col("rank").alias("root"), F.col("root").alias("_next"))
        doubled = spread_join(far, ahead, ["root"], ["rank"], "left")
        far = materialize(doubled.select("rank", F.coalesce("_next", "root").alias("root")), "links")
        reach *= 2
    return far


def variant_groups(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``counts`` (``word, n``; words are distinct).

    Words are near if exactly one inserted, deleted or replaced letter leads from one to the other. A word's
    form is its near word of largest ``n`` (of equal ones the first in code-point order), if that is
    at least ``ratio`` times the word's own; else it has none and is its own root. Following forms from a word to
    the last leads to its root. A word of any length is one row; a null word is left out.
    No words, no rows; other columns of ``counts`` are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that chains of forms end")
    words = counts.filter("word is not null").select("word", "n", (-F.col("n")).alias("_less"))
    # By frequency, then by code points: the best of some words is the one of least rank.
    words = materialize(number_rows(words, ["_less", "word"], "rank").select("rank", "word", "n"), "vocabulary")
    found = materialize(neighbours(split_pairs(words)), "near")
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    formed = _merged(spread_join(found, best, ["best"], ["rank"]), words.select("rank", "n"))
    likely = F.col("form_n") >= F.col("n") * ratio
    formed = materialize(
        formed.select(
            "rank", "n_near", F.when(likely, F.col("best")).alias("best"),
            F.when(likely, F.col("form")).alias("form"), F.when(likely, F.col("form_n")).alias("form_n"),
        ),
        "formed",
    )
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(formed.filter("best is not null").select("rank", F.col("best").alias("form")), most, ratio)
    ends = words.select(F.col("rank").alias("root"), F.col("word").alias("_root_word"))
    roots = spread_join(roots, ends, ["root"], ["rank"]).select("rank", F.col("_root_word").alias("root"))
    return _merged(_merged(words, formed, "left"), roots, "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
    )
