"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from passageloom.plans import oracles, registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.all_queries(), oracles.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def normal(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert normal(got, columns) == normal(want, columns)


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.columns == ["query_id", "conv_id", "turn", "asked", "question", "canned", "prompt", "references", "request"]
    assert rows.count() == 14


def test_log_keeps_every_conversation(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in (-4, -3, -1, 0, 1, 2) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["activity_log"](spark, str(tmp_path)).toPandas()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = connection.execute(SQL["activity_log"]).df()
    assert len(got) == 12 and normal(got, sorted(want.columns)) == normal(want, sorted(want.columns))


def test_appends_hold_every_row(spark):
    pairs = spark.createDataFrame([(c,) for c in (-3, -2, 0, 1, None)], "conv_id long")
    even, odd = ({r.conv_id for r in part.collect()} for part in registry._by_parity(pairs))
    assert even == {-2, 0, None} and odd == {-3, 1}


@pytest.mark.parametrize("name", ["activity_stream", "live_drafts", "index_refresh"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    for table in ("conversations", "documents"):
        spark.read.parquet(f"{SF_DIR}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), QUERIES[name](spark, SF_DIR).toPandas()
    # Ids of the log follow the times; its rows are the same in any division.
    assert len(got) and normal(got, sorted(want.columns)) == normal(want, sorted(want.columns))
