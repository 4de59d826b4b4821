"""Line deduplication against a plain loop, batch by batch, and its store."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from passageloom.llm import line_dedup
from passageloom.llm.line_dedup import LineRuns
from passageloom.sources.versions import Conflict

WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def brute(rows, seen=()):
    """Rows ``(id, n_lines, n_dropped, text)``, and the keys seen after them."""
    first = {}
    for i, text in rows:
        for key in map(key_of, (text or "").split("\n")):
            if len(key) >= 10:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < 10 or (key_of(x) not in seen and first[key_of(x)] == i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out), set(seen) | set(first)


def some_rows(seed, ids):
    rng = random.Random(seed)
    pool = [f"Line {i} of a pool that is shared" for i in range(30)] + ["short", "", "  Line 3 OF a pool that is shared \t", "é" * 9, "É" * 10]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {rng.random()}" for _ in range(rng.randint(1, 30)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_batches_against_brute_force(spark, tmp_path):
    store, seen = LineRuns(spark, f"{tmp_path}/runs", fan_in=2), set()
    for n in range(6):
        rows = some_rows(n, range(100 * n, 100 * n + 20))
        expected, seen = brute(rows, seen)
        if n == 3:  # another session goes on with the store
            store.close()
            store = LineRuns(spark, f"{tmp_path}/runs", fan_in=2)
        assert sorted(tuple(r) for r in store.add(frame(spark, rows)).collect()) == expected
    # Six batches: merged to levels 2 and 1 by the time the last one came.
    assert sorted(level for _, level in store.levels) == [0, 0, 2]
    store.compact()
    assert sorted(level for _, level in store.levels) == [1, 2]
    hashes = [bytes(r.h) for r in store.hashes().collect()]
    assert sorted(hashes) == sorted(hashlib.sha256(k.encode()).digest()[:16] for k in seen)
    store.close()


def test_runs_are_not_shuffled_again(spark, tmp_path, plan):
    store = LineRuns(spark, f"{tmp_path}/runs")
    store.add(frame(spark, some_rows(1, range(30))))
    store.add(frame(spark, some_rows(2, range(30, 60))))
    a, b = (store._open(f) for f, _ in store.levels)
    assert "Exchange" not in plan(a.join(b.hint("merge"), "h", "left_anti"))
    rows = line_dedup.store_lines(frame(spark, some_rows(3, range(9))), "doc_id", "text")
    dropped = spark.createDataFrame([(0, 0, 1)], "part int, pos long, line int")
    with line_dedup.placed_by_part(spark):
        text = plan(line_dedup._rebuilt(rows, dropped, False))
    # The only exchange is that of the line numbers; texts are split once.
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    assert text.count("split(text") == 1
    store.close()


def test_the_slower_writer_fails(spark, tmp_path):
    one, two = LineRuns(spark, f"{tmp_path}/runs"), LineRuns(spark, f"{tmp_path}/runs")
    one.add(frame(spark, some_rows(1, range(5))))
    with pytest.raises(Conflict):
        two.add(frame(spark, some_rows(1, range(5))))
    again = LineRuns(spark, f"{tmp_path}/runs")
    assert again.number == 1 and len(again.levels) == 1


def test_a_failed_batch_leaves_the_store(spark, tmp_path, monkeypatch):
    store, rows = LineRuns(spark, f"{tmp_path}/runs"), some_rows(1, range(5))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(line_dedup, "_rebuilt", fail)
        with pytest.raises(RuntimeError):
            store.add(frame(spark, rows))
    again = LineRuns(spark, f"{tmp_path}/runs")
    assert sorted(tuple(r) for r in again.add(frame(spark, rows)).collect()) == brute(rows)[0]


def test_one_line_in_every_document_and_odd_ids(spark):
    rows = [(i, f"the very same line\n{i}\nTHE VERY SAME LINE ") for i in range(500)]
    rows += [(None, "the very same line"), (7, "the very same line"), (7, None), (-5, "")]
    out = {}
    for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect():
        out.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.text))
    assert out[None] == [(1, 0, "the very same line")]
    assert out[0] == [(3, 2, "0")] and out[499] == [(3, 2, "499")] and out[-5] == [(1, 0, "")]
    assert sorted(out[7]) == [(1, 0, ""), (1, 1, ""), (3, 2, "7")]


@pytest.mark.parametrize("batches", [1, 3])
def test_whole_table(spark, batches):
    rows = some_rows(9, range(60))
    got = line_dedup.drop_repeated_lines(frame(spark, rows), batches=batches).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)[0]


def test_awkward_rows_and_clashing_columns(spark, docs, rows):
    least = -(1 << 63)
    clashing = docs.withColumns({c: F.lit("x") for c in ("batch", "d", "h", "lines", "lost", "pos", "n_lines")})
    got = [(least if r.doc_id is None else r.doc_id, *r[1:]) for r in line_dedup.drop_repeated_lines(clashing).collect()]
    assert sorted(got) == brute([(least if r[0] is None else r[0], r[1]) for r in rows])[0]
    assert line_dedup.drop_repeated_lines(clashing.limit(0)).collect() == []
