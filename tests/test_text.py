import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from passageloom.functions import text as tx
from passageloom.functions.filters import compile_filter


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


def test_clean_page_text(spark):
    assert one(spark, "a\nb\u0000c", tx.clean_page_text) == "a b c"
    assert one(spark, None, tx.clean_page_text) is None


@pytest.mark.parametrize(
    "text", ["", "  ", "one", " one  two ", "a b c", "a  b c d", "a\tb\nc d e", " x y　z w", None]
)
def test_limit_words_is_python_split(spark, text):
    words = text.split() if text is not None else []
    expected = " ".join(words[:3]) if len(words) > 3 else text
    got = one(spark, text, lambda c: tx.limit_words(c, 3))
    assert got == expected
    assert one(spark, got, lambda c: tx.limit_words(c, 3)) == expected


def test_limit_words_range():
    for n in (0, 32001):
        with pytest.raises(ValueError):
            tx.limit_words(None, n)


def test_quotes_and_dollars(spark):
    assert one(spark, "it's '$5'", tx.strip_quotes) == "its $5"
    assert one(spark, "it's '$5'", tx.escape_dollar) == "it's '\\$5'"


def reply(message):
    return json.dumps({"choices": [{"messages": message}]})


@pytest.mark.parametrize(
    "given, expected",
    [
        (reply("an answer"), "an answer"),
        (reply(""), "missing"),
        (reply(None), "missing"),
        (None, "missing"),
        ("{}", "error"),
        ("not json", "error"),
    ],
)
def test_answers_of_replies(spark, given, expected):
    assert one(spark, given, lambda c: tx.answer_or_error(c, "missing", "error")) == expected


def test_extract_and_fallback(spark):
    assert one(spark, reply("x"), tx.extract_answer) == "x"
    assert one(spark, "", lambda c: tx.fallback_answer(c, "d")) == "d"
    assert one(spark, None, lambda c: tx.fallback_answer(c, "d")) == "d"


@pytest.mark.parametrize("month, hour", [(1, 15), (7, 14)])
def test_zones_follow_daylight_saving(spark, month, hour):
    # Noon in Los Angeles is 20:00 UTC in winter and 19:00 in summer; Bogota is UTC-5 all year.
    got = one(spark, dt.datetime(2024, month, 5, 12), tx.convert_tz, "timestamp_ntz")
    assert got == dt.datetime(2024, month, 5, hour)


def test_tokenizers(spark):
    text = 'Él dijo: "3.5, no-más" & 1,000-2 $x$ don\'t. End.'
    assert one(spark, text, tx.tokens) == "él dijo 3 5 no más 1 000 2 x don t end".split()
    assert one(spark, text, lambda c: tx.tokens(c, "ascii")) == "l dijo 3 5 no m s 1 000 2 x don t end".split()
    assert one(spark, text, lambda c: tx.tokens(c, "13a")) == (
        'Él dijo : " 3.5 , no-más " & 1,000 - 2 $ x $ don\'t . End .'.split()
    )
    assert one(spark, "a &lt;b&gt; &quot;c&quot;\nd", lambda c: tx.tokens(c, "13a")) == 'a < b > " c " d'.split()
    assert one(spark, None, tx.tokens) == []
    with pytest.raises(ValueError):
        tx.tokens(F.lit("x"), "other")


def test_ngrams(spark):
    assert one(spark, ["a", "b", "c"], lambda c: tx.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: tx.ngrams(c, 2), "array<string>") == []
    assert one(spark, [], lambda c: tx.ngrams(c, 3), "array<string>") == []


def test_filter_expressions(spark):
    df = spark.createDataFrame([(1, "es", "x"), (2, "en", "x"), (3, "es", "y"), (4, None, "x")], "id int, language string, kind string")
    ids = lambda expr: [r.id for r in df.filter(compile_filter(expr)).orderBy("id").collect()]
    assert ids({}) == ids(None) == ids({"@and": []}) == [1, 2, 3, 4]
    assert ids({"@eq": {"language": "es"}}) == [1, 3]
    assert ids({"@and": [{"@eq": {"language": "es"}}, {"@and": [{"@eq": {"kind": "x"}}]}]}) == [1]
    for bad in ({"@or": []}, {"@eq": {"a": 1, "b": 2}}, {"@and": {}}, {"@eq": {"a": 1}, "@and": []}, ["x"]):
        with pytest.raises(ValueError):
            compile_filter(bad)
