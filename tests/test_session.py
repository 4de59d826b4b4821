import os

from passageloom.operators.chunking import chunk_words
from passageloom.operators.scoring import ngram_counts, score_bleu, score_pairs
from passageloom.plans import registry
from passageloom.session import drop_scratch, materialize, scratch_path


def test_scratch_tables(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    empty = materialize(spark.range(0), "empty")
    assert empty.count() == 0 and empty.dtypes == spark.range(0).dtypes
    stored = materialize(spark.range(3), "rows")
    assert stored.count() == 3
    folder = os.path.dirname(first)
    assert os.listdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)


def test_scoring_moves_no_rows(spark, plan):
    pairs = spark.createDataFrame([("1", "a b", "a c")], "pair_id string, reference string, candidate string")
    for scored in (score_pairs(pairs), score_pairs(pairs, "unicode", stemmed=False), score_bleu(pairs)):
        assert "Exchange" not in plan(scored) and plan(scored).count("ArrowEvalPython") == 1
    texts = pairs.withColumnRenamed("candidate", "text")
    assert "Exchange" not in plan(ngram_counts(texts, 2))


def test_filter_runs_before_python(spark, plan, tmp_path):
    docs = [(1, "a b", "es", "s", 3), (2, "c d", "en", "s", 3)]
    spark.createDataFrame(docs, registry.schemas.DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    text = plan(registry.all_queries()["retrieve_filtered"](spark, str(tmp_path)))
    assert "EqualTo(lang,es)" in text and "n_chars" not in text
    assert text.index("ArrowEvalPython") < text.index("Filter (isnotnull(lang")


def test_python_only_where_needed(spark, plan, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert plan(chunk_words(df)).count("ArrowEvalPython") == 1
    for name in ("history_last_n", "qa_pairs", "grouped_sum", "limit_words", "route_canned", "open_questions"):
        assert "Python" not in plan(registry.all_queries()[name](spark, "/root/testdata/sf0.001")), name
