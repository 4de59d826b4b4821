import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("part", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "ti", "sh", "ea"]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def awkward_rows():
    """Nulls in every column, empty, blank, short and very long texts, copies, near copies and a repeated row."""
    rng = random.Random(3)
    base = prose(rng, 300)
    words = base.split(" ")
    near = " ".join([*words[:150], "changed", *words[151:]])
    far = " ".join(w if i % 7 else "other" for i, w in enumerate(words))
    texts = [None, "", " \t\n", "one", "one two three", base, base, base, near, far, prose(rng, 20_000), base + " " + prose(rng, 50)]
    texts += ["x" * 5000, "AKIA" + "Z" * 16 + " token: 'abcdefgh12'", "é ☃ 漢字\x00 " * 40, "A! | B | C |\n" * 60]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 5}" if i % 4 else "s0", len(t or ""), "p", "9", "k") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


# The last three are names that operators use inside.
MESSAGES = "conv_id long, turn long, role string, text string, c string, position long, letter string"


def awkward_messages():
    """Nulls in every column, gaps, equal turns, repeated rows, empty and long texts, unknown roles, one long conversation."""
    rng = random.Random(5)
    ends = [".", "?", "!", "", " ", ".\u00a0", "!\n"]

    def text():
        return rng.choice([None, "", " \t\n", "Same text.", prose(rng, rng.randint(1, 30)), prose(rng, 5)[:-1] + rng.choice(ends)])

    def row(conv, turn):
        return (conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "úser"]), text(), "x", 7, "D")

    rows = [row(c, rng.choice([None, t, t, t, 2 * t, t - 1])) for c in [None, -3, *range(60)] for t in range(rng.randint(1, 9))]
    rows += [row(99, t) for t in range(1300)] + [(98, 0, "user", "long " * 100_000, None, None, None), (97, 0, None, None, None, None, None)]
    return rows + rows[:5] + rows[10:12] * 3


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table_dir(spark, docs, tmp_path_factory):
    """The awkward rows and a few labels as the tables that the queries read."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.select(*SCHEMA.fieldNames()[:5]).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("|" not in (r[1] or "")), 0) for i, r in enumerate(awkward_rows()[:50]) if i % 2] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://x.org", "https://x.org/fr/a",
            "http://cheap-pills.example.com/", "http://casinos.com/casino", "http://a.com/p?cheap=1&win=2", "http://net/"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(awkward_messages(), MESSAGES).write.parquet(f"{folder}/conversations.parquet")
    return folder
