"""Chunks straight from pages against the chunks of assembled texts."""

import random

import pytest
from pyspark.sql import functions as F

from passageloom.functions.words import chunk_links, word_chunks
from passageloom.operators.chunking import chunk_words
from passageloom.operators.paged_chunks import chunk_pages
from passageloom.operators.pages import assemble_pages


def frame(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, page_no int, text string").repartition(5)


def random_page(rng):
    kind = rng.random()
    if kind < 0.08:
        return None
    if kind < 0.2:
        return rng.choice(["", " ", "\n", "\t \x00"])
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 5, 8, 30, 70]))) for _ in range(rng.randint(1, 9))]
    return rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n"]).join(words) + rng.choice(["", " ", " "])


@pytest.mark.parametrize("mode", ["reference", "skip"])
@pytest.mark.parametrize("size, overlap, block", [(20, 6, 12), (20, 0, 13), (9, 8, 40)])
def test_chunks_of_assembled_pages(spark, mode, size, overlap, block):
    rng = random.Random(size + overlap)
    rows = [(f"f{f}", 3 * p, random_page(rng)) for f in range(25) for p in range(rng.choice([1, 2, 10, 60]))]
    rows += [("no white space", p, "x" * rng.randint(1, 50)) for p in range(40)] + [("blank", 1, " \n"), (None, 1, "lost")]
    pages = frame(spark, rows)
    texts = assemble_pages(pages.filter("relative_path is not null"), mode=mode)
    expected = chunk_words(texts, size=size, overlap=overlap)
    got = chunk_pages(pages, mode=mode, size=size, overlap=overlap, block=block)
    assert sorted(got.collect()) == sorted(expected.select(*got.columns).collect())


def test_a_file_of_a_million_words(spark):
    rng = random.Random(1)
    words = [rng.choice("abcdefghij") * rng.randint(1, 12) for _ in range(1_000_000)]
    words[500_000] = "z" * 9_000  # an overlong word over many pages
    text = " ".join(words)
    cuts = sorted(rng.sample(range(len(text)), 3000))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    got = chunk_pages(frame(spark, [("big", i, p) for i, p in enumerate(parts)])).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in got] == list(range(len(got)))
    assert [r.chunk for r in got] == word_chunks(text, 2000, 300)


def test_walks_that_never_meet(spark):
    """Words of one length: walks from different entries never come together, so every link counts."""
    text = "ab " * 4000
    rows = [("even", i, text[i * 100 : i * 100 + 100]) for i in range(120)]
    got = chunk_pages(frame(spark, rows), size=30, overlap=10, block=17).orderBy("chunk_no").collect()
    assert [r.chunk for r in got] == word_chunks(text, 30, 10)


def test_no_row_holds_a_file(spark):
    pages = frame(spark, [("a", i, "word " * 100) for i in range(200)])
    plan = chunk_pages(pages, size=40, overlap=10, block=50)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_links_are_those_of_chunks():
    rng = random.Random(4)
    for _ in range(300):
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        size, at, chunks = 12, 0, []
        links = chunk_links([len(w) for w in words], size, 5)
        while at < len(words):
            final, following = links[at]
            chunks.append(" ".join(words[at : final + 1]))
            at = following
        assert chunks == word_chunks(" ".join(words), size, 5)


def test_odd_tables(spark):
    assert chunk_pages(frame(spark, [])).collect() == []
    assert chunk_pages(frame(spark, [("a", 1, None)])).collect() == [("a", 0, "Unable to Extract")]
    with pytest.raises(ValueError):
        chunk_pages(frame(spark, []), block=10)
    with pytest.raises(ValueError):
        chunk_pages(frame(spark, []), mode="other")
    numbers = frame(spark, [("7", 1, "one two")]).withColumn("relative_path", F.col("relative_path").cast("long"))
    assert chunk_pages(numbers).collect() == [(7, 0, "one two")]
