"""Schemas of the tables this package reads and writes."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


DOCUMENTS = _struct(
    ("doc_id", T.LongType()),
    ("text", T.StringType()),
    ("lang", T.StringType()),
    ("source", T.StringType()),
    ("n_chars", T.LongType()),
)

MESSAGES = _struct(
    ("conv_id", T.LongType()),
    ("turn", T.LongType()),
    ("role", T.StringType()),
    ("text", T.StringType()),
)

CHUNKS = _struct(
    ("doc_id", T.LongType()),
    ("chunk_no", T.IntegerType()),
    ("relative_path", T.StringType()),
    ("file_url", T.StringType()),
    ("chunk", T.StringType()),
    ("language", T.StringType()),
)

POSTINGS = _struct(
    ("doc_id", T.LongType()),
    ("chunk_no", T.IntegerType()),
    ("language", T.StringType()),
    ("dl", T.IntegerType()),
    ("term", T.StringType()),
    ("tf", T.LongType()),
)

LENGTHS = _struct(
    ("doc_id", T.LongType()),
    ("chunk_no", T.IntegerType()),
    ("dl", T.IntegerType()),
)

COUNTED = _struct(
    ("doc_id", T.LongType()),
    ("chunk_no", T.IntegerType()),
    ("language", T.StringType()),
    ("dl", T.IntegerType()),
    ("counts", T.ArrayType(_struct(("term", T.StringType()), ("tf", T.LongType())))),
)

TERMS = _struct(("term", T.StringType()), ("df", T.LongType()))

ACTIVITY = _struct(
    ("id", T.LongType()),
    ("question", T.StringType()),
    ("answer", T.StringType()),
    ("logged_at", T.TimestampNTZType()),
)

