import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passageloom.functions.words import word_chunks
from passageloom.operators.chunking import chunk_chars, chunk_words, register_chunk_words, split_texts

TEXTS = [
    "",
    "   ",
    "short text",
    " ".join(f"word{i}" for i in range(2000)),
    "x" * 5000,
    "a " * 1500 + "y" * 4100 + " z" * 900,
    "ñandú " * 700,
    None,
]


def by_hand(text, size, overlap):
    """The chunk rule word by word, without offsets kept in lists."""
    words = []
    for word in text.split():
        while len(word) > size:
            words.append(word[:size])
            word = word[size - overlap :]
        words.append(word)
    joined = lambda a, b: " ".join(words[a : b + 1])
    chunks, a = [], 0
    while words:
        b = a
        while b + 1 < len(words) and len(joined(a, b + 1)) <= size:
            b += 1
        chunks.append(joined(a, b))
        if b == len(words) - 1:
            break
        following = b + 1
        while following - 1 > a and len(joined(following - 1, b)) <= overlap:
            following -= 1
        a = following
    return chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=14), max_size=40), st.integers(4, 12), st.integers(0, 3))
def test_rule_and_properties(words, size, overlap):
    text = "  ".join(words)
    chunks = word_chunks(text, size, overlap)
    assert chunks == by_hand(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert bool(chunks) == bool(words)


def test_frames(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for row in chunk_words(df).collect():
        got.setdefault(row.doc_id, []).append((row.chunk_no, row.chunk))
    expected = {i: list(enumerate(by_hand(t, 2000, 300))) for i, t in enumerate(TEXTS) if t and t.strip()}
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_table_function_is_the_same_lateral_join(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    df.createOrReplaceTempView("texts")
    register_chunk_words(spark)
    sql = spark.sql("SELECT doc_id, chunk_no, chunk FROM texts, LATERAL chunk_words(text, 200, 30)")
    assert sorted(sql.collect()) == sorted(chunk_words(df, size=200, overlap=30).collect())


def test_windows(spark):
    df = spark.createDataFrame([(0, ""), (1, "abcdefghij"), (2, "abcdé"), (3, None), (4, "abcdefghijk")], "doc_id long, text string")
    rows = {}
    for row in chunk_chars(df, size=5, overlap=2).orderBy("doc_id", "chunk_no").collect():
        rows.setdefault(row.doc_id, []).append(row.chunk)
    assert rows == {1: ["abcde", "defgh", "ghij"], 2: ["abcdé"], 4: ["abcde", "defgh", "ghijk"]}


def test_bounds():
    for overlap in (-1, 5):
        with pytest.raises(ValueError):
            chunk_chars(None, size=5, overlap=overlap)


def test_no_shuffle(spark, plan):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    assert "Exchange" not in plan(chunk_words(df))
    assert "Exchange" not in plan(chunk_chars(df)) and "Python" not in plan(chunk_chars(df))


def test_few_texts_are_split_at_once():
    parts = list(split_texts(iter([pd.Series(["a b c", None, ""] * 500), pd.Series([], dtype=object)]), 10, 2))
    assert max(map(len, parts)) <= 100 and pd.concat(parts).tolist() == [["a b c"], None, []] * 500


def test_batches_of_many_texts(spark):
    rows = spark.range(0, 2500, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("w x "), F.col("id"))).alias("text"))
    got = {r.id: r.chunk for r in chunk_words(rows, size=2000, overlap=300).collect()}
    assert got == {i: f"w x {i}" for i in range(2500) if i % 7}
