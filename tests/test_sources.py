import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from passageloom import schemas
from passageloom.operators.corpus import project, with_language
from passageloom.operators.pages import assemble_pages
from passageloom.sources import files


def test_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "B.PDF", "c.txt", "sub/d.pdf"):
        (tmp_path / name).write_bytes(b"0123")
    listed = files.list_sources(spark, str(tmp_path))
    assert {r.relative_path for r in listed.collect()} == {"a.pdf", "B.PDF", "c.txt", "sub/d.pdf"}
    assert {r.length for r in listed.collect()} == {4} and "content" not in listed.columns
    assert {r.relative_path for r in files.filter_extension(listed).collect()} == {"a.pdf", "B.PDF", "sub/d.pdf"}
    assert {r.relative_path for r in files.list_sources(spark, str(tmp_path), "*.txt").collect()} == {"c.txt"}


def test_latest(spark, plan):
    rows = [("p", 1, "old"), ("p", 3, "new"), ("q", 1, "only"), ("p", 2, "mid")]
    latest = files.latest_per_path(spark.createDataFrame(rows, "path string, v int, text string"), "path", ["v"])
    assert {(r.path, r.text) for r in latest.collect()} == {("p", "new"), ("q", "only")}
    assert plan(latest).count("WindowGroupLimit") == 2  # before and after the shuffle


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_pairs_are_read_by_name(spark, tmp_path, fmt):
    rows = [("x", 7, 'say "hi", then\ngo', "1"), (None, 8, "it's, $5", "2")]
    path = str(tmp_path / fmt)
    sheet = spark.createDataFrame(rows, "model string, remark int, human string, row string")
    sheet.write.options(header=True, escape='"').format(fmt).save(path)
    read = files.read_pairs(spark, path, "human", "model", "row", fmt)
    assert read.columns == ["pair_id", "reference", "candidate"]
    assert sorted(tuple(r) for r in read.collect()) == [(r[3], r[2], r[0]) for r in rows]
    plain = files.read_pairs(spark, path, "human", "model", fmt=fmt)
    assert plain.columns == ["reference", "candidate"] and plain.count() == 2
    with pytest.raises(ValueError, match="other"):
        files.read_pairs(spark, path, "other", "model", fmt=fmt)


def chunk_rows(*languages):
    return [(i, 0, f"f{i}", f"u{i}", f"c{i}", lang) for i, lang in enumerate(languages)]


def test_chunk_table_is_replaced(spark, tmp_path, plan):
    path = str(tmp_path / "chunks")
    for languages in (("es", "en", "es"), ("fr", "es")):
        files.write_chunks(spark.createDataFrame(chunk_rows(*languages), schemas.CHUNKS), path=path)
        back = files.read_chunks(spark, path=path).select(*schemas.CHUNKS.fieldNames())
        assert sorted(tuple(r) for r in back.collect()) == chunk_rows(*languages)
    assert "PartitionFilters: [isnotnull(language" in plan(back.filter("language = 'es'"))
    with pytest.raises(ValueError):
        files.write_chunks(back)


def test_log_only_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    pairs = "conv_id long, turn long, question string, answer string, ts timestamp_ntz"
    for append in range(3):
        rows = [(c, 0, f"q{append}.{c}", "a$", dt.datetime(2024, 1, 1, 12, c)) for c in range(append)]
        files.append_activity(spark.createDataFrame(rows, pairs), path)
    log = files.read_activity(spark, path).orderBy("id").collect()
    assert [(r.id, r.question) for r in log] == [(1, "q1.0"), (2, "q2.0"), (3, "q2.1")]


def test_two_writers_at_once(spark, tmp_path):
    path, pairs = str(tmp_path / "log"), "conv_id long, turn long, question string, answer string, ts timestamp_ntz"

    def append(writer):
        for _ in range(3):
            rows = [(writer, t, f"{writer}.{t}", "a", dt.datetime(2024, 1, 1, 12, t)) for t in range(writer + 2)]
            files.append_activity(spark.createDataFrame(rows, pairs), path)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(append, (0, 1)))
    rows = files.read_activity(spark, path).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 16))
    # Every append is a run of ids, in the order of its times.
    text = " ".join(r.question for r in rows)
    assert text.count("0.0 0.1") == 3 and text.count("1.0 1.1 1.2") == 3


def test_a_batch_gets_its_ids_again(spark, tmp_path):
    path = str(tmp_path / "log")
    assert files.reserve_ids(spark, path, 5, "s", 0) == 1
    assert files.reserve_ids(spark, path, 2) == 6
    assert files.reserve_ids(spark, path, 5, "s", 0) == 1
    assert files.reserve_ids(spark, path, 1, "s", 1) == 8
    assert files.read_activity(spark, path).count() == 0


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "chunks")
    files.write_chunks(spark.createDataFrame(chunk_rows("es", "en"), schemas.CHUNKS), path=path)
    opened = files.read_chunks(spark, path=path)
    files.write_chunks(spark.createDataFrame(chunk_rows("fr"), schemas.CHUNKS), path=path)
    assert {r.language for r in opened.collect()} == {"es", "en"}
    assert {r.language for r in files.read_chunks(spark, path=path).collect()} == {"fr"}
    with pytest.raises(Exception, match="broken"):  # a version that can't be written never becomes the table
        bad = spark.createDataFrame(chunk_rows("de"), schemas.CHUNKS).withColumn("chunk", F.raise_error(F.lit("broken")).cast("string"))
        files.write_chunks(bad, path=path)
    assert {r.language for r in files.read_chunks(spark, path=path).collect()} == {"fr"}
    files.write_chunks(spark.createDataFrame(chunk_rows("it"), schemas.CHUNKS), path=path)
    assert len(list((tmp_path / "chunks").glob("version-*"))) == 3  # two versions and the broken one
    with pytest.raises(ValueError):
        files.read_chunks(spark, path=str(tmp_path / "none"))


def test_projection_and_language(spark):
    df = spark.createDataFrame([(1, "a")], "id int, lang string")
    assert project(df).columns == ["id", "lang"] and project(df, ["lang"]).columns == ["lang"]
    assert with_language(df, "es").first().language == "es"
    assert with_language(df, df.lang).first().language == "a"


def test_pages(spark):
    pages = spark.createDataFrame(
        [
            ("good", 2, "b\nc"), ("good", 1, "a"),
            ("first", 1, None), ("first", 2, "x"), ("first", 3, "y"),
            ("last", 1, "x"), ("last", 2, None),
            ("two", 1, None), ("two", 2, "x"), ("two", 3, None), ("two", 10, "z"), ("two", 9, "y"),
        ],
        "relative_path string, page_no int, text string",
    )
    names = spark.createDataFrame([(n,) for n in ("good", "first", "last", "two", "none")], "relative_path string")
    got = lambda **kw: {r.relative_path: r.text for r in assemble_pages(pages, names, **kw).collect()}
    mark = "Unable to Extract"
    assert got() == {"good": "ab c", "first": mark + "xy", "last": mark, "two": mark + "yz", "none": ""}
    assert got(mode="skip", sep="|") == {"good": "a|b c", "first": "x|y", "last": "x", "two": "x|y|z", "none": ""}
    with pytest.raises(ValueError):
        assemble_pages(pages, mode="other")
