"""Spelling variants against a comparison of all words, and the numbers of trie nodes."""

import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from passageloom.llm import spelling
from passageloom.operators.joins import spread_join
from passageloom.session import materialize


def near(a, b):
    """Whether one inserted, deleted or replaced letter leads from ``a`` to ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    form, out = {}, {}
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    for w in counts:
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(close[w]), form[w], counts[form[w]] if form[w] is not None else None, root)
    return out


def groups(spark, counts, partitions=3, **more):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(partitions)
    rows = spelling.variant_groups(frame.withColumn("rank", F.lit("x")).withColumn("form", F.lit("y")), **more).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_groups_against_all_pairs(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"", "a", "aaaaaaa", "aaaaaaaa"}
    counts = {w: 5 ** rng.randint(0, 6) + rng.randint(0, 3) for w in words}
    assert groups(spark, counts) == brute(counts)
    assert groups(spark, counts, ratio=2) == brute(counts, 2)


def test_runs_of_letters_count_once(spark):
    counts = {"aaab": 100, "aaaab": 20, "aab": 3, "aaac": 5, "b" * 3000: 9, "b" * 3001: 50}
    assert groups(spark, counts) == brute(counts)


def test_ties_and_long_chains(spark):
    counts = {"a" * i: 5**i for i in range(1, 9)} | {"xyzab": 10, "xyzac": 10, "xyzad": 2}
    found = groups(spark, counts)
    assert found == brute(counts)
    assert found["a"][4] == "a" * 8 and found["xyzad"][2] == "xyzab"


def test_one_pair_with_every_letter(spark):
    """A pair that a word of every letter is in: no two of them are put side by side."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {f"prefix{x}suffix": 7 + i for i, x in enumerate(letters)} | {"prefixsuffix": 1000}
    found = groups(spark, counts)
    assert found == brute(counts)
    assert found["prefixsuffix"][1] == len(letters)


def test_trie_nodes_are_prefixes(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {"é", "éa", "漢字"})
    frame = spark.createDataFrame(list(enumerate(words)), "rank long, word string").repartition(5)
    ids = {}
    for row in spelling.trie_nodes(frame, "word", "t").collect():
        word = words[row["rank"]]
        assert len(row.nodes) == len(word) + 1
        for k, node in enumerate(row.nodes):
            assert ids.setdefault(word[:k], node) == node
    assert len(set(ids.values())) == len(ids) == len({w[:k] for w in words for k in range(len(w) + 1)})


def test_counted_words(spark):
    rng = random.Random(3)
    pool = ["Résumé", "RESUME", "résumé", "ÉCOLES", "short", "naïvetés", "x" * 50_000, "letters", "Letters", "l'ombrage", "a_longer_one"]
    rows = [(i, " ".join(rng.choice(pool[:-5] + pool[-4:]) for _ in range(80))) for i in range(300)]
    rows += [(None, "letters letters letters"), (5, None), (6, ""), (6, "letters"), (8, pool[6])] + [(9, pool[6] + " " + pool[6])] * 2
    expected = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.word: r.n for r in spelling.count_words(frame, damage=True).collect()}
    assert got == expected
    assert "lette" not in got and any(n < 20 for n in expected.values())


def test_no_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_groups(empty).collect() == []
    null = spark.createDataFrame([(None, 9), ("single", 5)], "word string, n long")
    assert [tuple(r) for r in spelling.variant_groups(null).collect()] == [("single", 5, 0, None, None, "single")]


def test_no_table_of_words_is_broadcast(spark, plan):
    """A small file may hold many words: what is broadcast passes through the driver."""
    words = [("".join(p), i + 5) for i, p in enumerate(itertools.product("abc", repeat=6))]
    counts = spark.createDataFrame(words, "word string, n long")
    assert "Broadcast" not in plan(spelling.variant_groups(counts))


def test_the_repeated_side_of_a_spread_join_is_not_broadcast(spark, plan):
    rows = materialize(spark.range(1000).selectExpr("id % 10 AS k", "id"), "rows")
    one = materialize(spark.range(10).selectExpr("id AS k", "id * 2 AS v"), "one")
    joined = spread_join(rows, one, ["k"], ["id"], "left")
    assert "Broadcast" not in plan(joined)
    assert joined.filter("v = 2 * k").count() == 1000
