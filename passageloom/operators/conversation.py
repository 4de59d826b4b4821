"""Operators on message logs ``(conv_id, turn, role, text)``.

``turn`` orders the messages of a conversation and may have gaps. Messages are
numbered densely where neighbours matter; "the message after" and "the last n
before" are then equi-joins on ``(conv_id, position)``, which spread even one
huge conversation over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageloom.functions.text import strip_space
from passageloom.operators.joins import spread_join
from passageloom.operators.ordering import running_total


# Turns of a conversation that one window may hold.
TURN_RANGE = 10_000


def _check_n(n: int) -> None:
    if not 1 <= n <= 10:
        raise ValueError("n must be between 1 and 10")


def history_last_n(df: DataFrame, n: int = 5, include_current: bool = True) -> DataFrame:
    """The last ``n`` messages of each conversation.

    ``include_current=False`` leaves the newest message out first. The rank
    limit is applied before the shuffle, so each task sends at most ``n + 1``
    messages of a conversation.
    """
    _check_n(n)
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    skip = 0 if include_current else 1
    ranked = df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n + skip)
    return ranked.filter(F.col("_back") > skip).drop("_back")


def history_since_clear(df: DataFrame, is_clear: Column) -> DataFrame:
    """Messages after the latest clear marker of their conversation; all if there is none."""
    cleared = df.filter(is_clear).groupBy("conv_id").agg(F.max("turn").alias("_cleared"))
    marked = spread_join(df, cleared, ["conv_id"], ["turn"], how="left")
    return marked.filter(F.col("_cleared").isNull() | (F.col("turn") > F.col("_cleared"))).select(*df.columns)


def positions(messages: DataFrame) -> DataFrame:
    """Adds ``position``: 0, 1, 2, ... in the order of ``turn``, without gaps. ``(conv_id, turn)`` is unique."""
    ones = messages.withColumn("_one", F.lit(1))
    return running_total(ones, ["conv_id"], ["turn"], "_one", "position").drop("_one")


def user_questions(numbered: DataFrame) -> DataFrame:
    """Every user message of ``positions`` as ``(query_id, conv_id, turn, position, text)``."""
    query_id = F.concat_ws("/", "conv_id", "turn").alias("query_id")
    return numbered.filter(F.col("role") == "user").select(query_id, "conv_id", "turn", "position", "text")


def unanswered(questions: DataFrame, numbered: DataFrame) -> DataFrame:
    """Questions without an assistant message directly after them."""
    answers = numbered.filter(F.col("role") == "assistant").select("conv_id", (F.col("position") - 1).alias("position"))
    return questions.join(answers, ["conv_id", "position"], "left_anti")


def history_before(questions: DataFrame, numbered: DataFrame, n: int = 5, include_current: bool = True) -> DataFrame:
    """Up to ``n`` messages that end with each question (or just before it), as ``(query_id, turn, role, text)``.

    A question names the ``n`` positions it needs, so nothing but those messages is joined.
    """
    _check_n(n)
    skip = 0 if include_current else 1
    wanted = questions.select(
        "query_id",
        "conv_id",
        F.explode(F.sequence(F.col("position") - (n - 1 + skip), F.col("position") - skip)).alias("position"),
    ).filter("position >= 0")
    return wanted.join(numbered, ["conv_id", "position"]).select("query_id", "turn", "role", "text")


def format_history(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, history)``: ``role: text`` lines in order. Give it at most the last ten messages."""
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("history"))


def pair_turns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each user message with the assistant message directly after it, whatever the gaps in ``turn``.

    ``keep`` names further columns to take from the assistant message. A conversation is split into
    ranges of turns, so a window holds a bounded part of it; where a range ends, the message after it
    is the first of the next range, and only these first messages move once more.
    """
    message = F.struct("turn", "role", "text", *keep)
    ranged = df.withColumn("_range", F.floor(F.col("turn") / TURN_RANGE))
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn")
    followed = ranged.withColumn("_next", F.lead(message).over(inside))
    firsts = ranged.groupBy("conv_id", "_range").agg(F.min(message).alias("_first"))
    ranges = Window.partitionBy("conv_id").orderBy("_range")
    edges = firsts.withColumn("_first", F.lead("_first").over(ranges)).filter("_first is not null")
    paired = followed.join(edges, ["conv_id", "_range"], "left").withColumn("_next", F.coalesce("_next", "_first"))
    return paired.filter((F.col("role") == "user") & (F.col("_next.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("_next.text").alias("answer"), *(f"_next.{c}" for c in keep)
    )


def route_canned(df: DataFrame, replies: dict[str, str], col: str = "question") -> DataFrame:
    """Add ``canned``: the fixed reply if the question, trimmed and lower-cased, is a known phrase.

    The few phrases are part of the expression, so no join is needed.
    """
    normal = F.lower(strip_space(F.col(col)))
    reply = F.lit(None).cast("string")
    for phrase, text in replies.items():
        reply = F.when(normal == phrase, F.lit(text)).otherwise(reply)
    return df.withColumn("canned", reply)


def append_note(df: DataFrame, keyword: str, note: str, question: str = "question", answer: str = "answer") -> DataFrame:
    """Append ``note`` to the answer where the question contains ``keyword``, ignoring case."""
    found = F.coalesce(F.lower(question).contains(keyword.lower()), F.lit(False))
    return df.withColumn(answer, F.when(found, F.concat(answer, F.lit(note))).otherwise(F.col(answer)))
