"""Conversations brought back to the form ``system? (user assistant)*`` by the cheapest edits.

Messages become one letter each, which tells the role's initial and the fault. The letters of
a conversation are searched depth first for the cheapest edits (``repair_table``): an explicit
stack, a lower bound of what every suffix still costs, the best repair found so far, and per
node (messages read, state) the best way there, so that worse prefixes end at once. The search is
over when the stack is empty: nothing left could be cheaper, or as cheap with a smaller audit.

A conversation longer than ``SEGMENT`` messages is searched in segments, from each state in
which a segment can begin to each in which it can end; tables of neighbouring segments are
composed, 64 at a time, until one is left. The texts are not part of any of this:
they are sorted by conversation once and edited as they stream past.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passageloom.llm.common import WORD, batched, rows_of
from passageloom.operators.joins import spread_join
from passageloom.operators.ordering import running_total
from passageloom.session import materialize

SEGMENT = 512
_TOGETHER = 64

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

# States: nothing yet, a system message, a user message, an answer. The repaired
# messages may end with nothing or with an answer.
_NOTHING, _SYSTEM, _USER, _ANSWER = range(4)
_NEXT = {
    _NOTHING: {"s": _SYSTEM, "u": _USER},
    _SYSTEM: {"u": _USER},
    _USER: {"a": _ANSWER},
    _ANSWER: {"u": _USER},
}
_WANTED = {_NOTHING: "u", _SYSTEM: "u", _USER: "a", _ANSWER: "u"}
_ENDS = (_NOTHING, _ANSWER)
ROLES = {"u": "user", "a": "assistant"}

# Letters: the role's initial (x for any other) with no fault; in upper case if the message is
# truncated. A message that has to go is a D, whatever its role.
GONE = "D"


class Repair(NamedTuple):
    cost: int
    audit: str


def suffix_bounds(letters: str, ends: frozenset[int]) -> list[dict[int, float]]:
    """What the messages from each place on cost at least, by state, if one of ``ends`` has to be reached.

    The problem relaxed: in front, any number of system messages may stay. What is left for the search is
    which one does, if any, and the least of the audits of equal cost.
    """
    never = float("inf")
    loose = {**_NEXT, _NOTHING: {"s": _NOTHING, "u": _USER}}

    def inserting(bound: dict[int, float]) -> dict[int, float]:
        for _ in range(2):
            bound = {s: min(b, INSERT_COST + bound[loose[s][_WANTED[s]]]) for s, b in bound.items()}
        return bound

    after = inserting({s: 0 if s in ends or (s == _NOTHING and _SYSTEM in ends) else never for s in loose})
    bounds = [after]
    for letter in reversed(letters):
        here = {}
        for state, follow in loose.items():
            cost = DELETE_COST + after[state]
            if letter != GONE:
                more = TRUNCATED_COST if letter.isupper() else 0
                if letter.lower() in follow:
                    cost = min(cost, more + after[follow[letter.lower()]])
                cost = min(cost, more + REROLE_COST + after[follow[_WANTED[state]]])
            here[state] = cost
        after = inserting(here)
        bounds.append(after)
    return bounds[::-1]


def search(letters: str, start: int, ends: frozenset[int]) -> Repair | None:
    """The cheapest repair of ``letters`` that leads from ``start`` to one of ``ends``; of equal costs the least audit."""
    n, bounds = len(letters), suffix_bounds(letters, ends)
    best: Repair | None = None
    tables: dict[tuple[int, int], Repair] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bounds[i][state]
        if least == float("inf"):
            continue
        if best is not None:
            if least > best.cost or (least == best.cost and audit > best.audit[: len(audit)]):
                continue
        known = tables.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        tables[i, state] = Repair(cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = Repair(cost, audit)
        ahead = []
        wanted = _WANTED[state]
        if i < n:
            letter = letters[i]
            if letter != GONE:
                more = TRUNCATED_COST if letter.isupper() else 0
                kept = _NEXT[state].get(letter.lower())
                if kept is not None:
                    ahead.append((i + 1, kept, cost + more, audit + KEEP))
                if kept is None or kept == _SYSTEM:
                    ahead.append((i + 1, _NEXT[state][wanted], cost + REROLE_COST + more, audit + REROLE))
            ahead.append((i + 1, state, cost + DELETE_COST, audit + DELETE))
        ahead.append((i, _NEXT[state][wanted], cost + INSERT_COST, audit + INSERT))
        # The most promising is on top of the stack: the least bound, then the least audit.
        ahead.sort(key=lambda x: (x[2] + bounds[x[0]][x[1]], x[3]), reverse=True)
        stack.extend(ahead)
    return best


Table = dict[tuple[int, int], Repair]


def repair_table(letters: str) -> Table:
    """The cheapest repair from every state to every other that it can lead to."""
    found = {(s, e): search(letters, s, frozenset([e])) for s in _NEXT for e in _NEXT}
    return {k: r for k, r in found.items() if r is not None}


def whole_repair(letters: str) -> Table:
    """The repair of a whole conversation, as a table of one entry."""
    return {(_NOTHING, _ANSWER): search(letters, _NOTHING, frozenset(_ENDS))}


def compose(left: Table, right: Table) -> Table:
    """The table of two neighbouring segments."""
    out: Table = {}
    for (s, m), a in left.items():
        for (k, e), b in right.items():
            if k == m:
                both = Repair(a.cost + b.cost, a.audit + b.audit)
                if (s, e) not in out or both < out[s, e]:
                    out[s, e] = both
    return out


# ---- damage ----------------------------------------------------------------------------------


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(messages: DataFrame) -> DataFrame:
    """``messages`` (``conv_id, turn, role, text``) with the faults that their checksums choose.

    By crc32 of ``conv_id:turn`` modulo 20, 0 drops a message, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes the user its role. Nulls count as one space, in
    the checksum too; ``conv_id`` and ``turn`` come out as they are.
    """
    code = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn"))) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(_filled("text"), "[.!?]", "")).otherwise(_filled("text"))
    role = F.when(code == 4, F.lit("user")).otherwise(_filled("role"))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("_copies", "_copy")


# ---- faults ----------------------------------------------------------------------------------

_KEY = ["c"]


def _letter() -> Column:
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(F.col("blank") | F.col("duplicate"), F.lit(GONE)).when(F.col("truncated"), F.upper(known)).otherwise(known)


def faults(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, judged)``: the stored messages, and per message ``c, position, rid``, its faults and its letter.

    ``c`` is the conversation as a string that is never null, ``position`` counts its messages
    by ``turn``, nulls first; messages of equal turns are ordered by role and the text's
    SHA-256. Texts go into neither the ordering nor the search for duplicates, their SHA-256 does.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    chars = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    rows = materialize(
        messages.select(
            conversation_key(F.col("conv_id")).alias("c"), "conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"),
            F.monotonically_increasing_id().alias("rid"),
        ).select(
            "*",
            F.unhex(F.sha2("text", 256)).alias("sha"),
            (~F.col("text").rlike(WORD)).alias("blank"),
            (~chars.rlike("[.!?]$")).alias("open_end"),
        ),
        "messages",
    )
    slim = rows.drop("text", "conv_id").withColumn("_one", F.lit(1))
    placed = materialize(running_total(slim, _KEY, ["turn", "role", "sha", "rid"], "_one", "position").drop("_one"), "placed")
    first = placed.groupBy("c", "role", "sha").agg(F.min("position").alias("_first"))
    judged = spread_join(placed, first, ["c", "role", "sha"], ["position"])
    judged = judged.withColumn("duplicate", ~F.col("blank") & (F.col("position") > F.col("_first")))
    judged = judged.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open_end"))
    judged = judged.select("c", "position", "rid", "turn", "role", "blank", "duplicate", "truncated", _letter().alias("letter"))
    return rows, materialize(judged, "judged")


# ---- search in segments ----------------------------------------------------------------------

_TABLE = "array<struct<start:int,end:int,cost:bigint,audit:string>>"


def _packed(table: Table) -> list[tuple[int, int, int, str]]:
    return [(*k, *r) for k, r in table.items()]


def _unpacked(entries) -> Table:
    return {(e["start"], e["end"]): Repair(e["cost"], e["audit"]) for e in entries}


def segment_tables(judged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``c, seg, whole, table``: the repairs of every segment; ``whole`` if it is a whole conversation."""
    at = (F.col("position") / segment).cast("long")
    letters = F.array_sort(F.collect_list(F.struct("position", "letter")))
    parts = judged.groupBy("c", at.alias("seg")).agg(
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("letters")
    )
    sizes = judged.groupBy("c").agg(F.max("position").alias("_last"))
    parts = spread_join(parts, sizes, ["c"], ["seg"]).withColumn("whole", F.col("_last") < segment).drop("_last")
    table_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("c", pa.string()), ("seg", pa.int64()), ("whole", pa.bool_()), ("table", table_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved():
            for c, seg, letters, whole in rows_of(batches, "c", "seg", "letters", "whole"):
                table = whole_repair(letters) if whole else repair_table(letters)
                yield c, seg, whole, [dict(zip(("start", "end", "cost", "audit"), e)) for e in _packed(table)]

        yield from batched(solved(), schema)

    tasks = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "c", "seg").mapInArrow(run, f"c string, seg long, whole boolean, table {_TABLE}")


def _composed(tables: DataFrame, spark: SparkSession) -> DataFrame:
    """``c, table`` of whole conversations: neighbours are composed until every conversation has one table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        table = _unpacked(pdf["table"].iloc[0])
        for entries in pdf["table"].iloc[1:]:
            table = compose(table, _unpacked(entries))
        packed = [dict(zip(("start", "end", "cost", "audit"), e)) for e in _packed(table)]
        return pd.DataFrame({"c": [pdf["c"].iloc[0]], "seg": [int(pdf["up"].iloc[0])], "table": [packed]})

    long = tables.filter("not whole").select("c", "seg", "table")
    segments = (long.agg(F.max("seg")).first()[0] or 0) + 1
    while segments > 1:
        above = long.withColumn("up", (F.col("seg") / _TOGETHER).cast("long"))
        long = materialize(above.groupBy("c", "up").applyInPandas(run, f"c string, seg long, table {_TABLE}"), "composed")
        segments = -(-segments // _TOGETHER)
    return tables.filter("whole").select("c", "table").unionByName(long.select("c", "table"))


def repairs(judged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``c, cost, audit`` of every conversation."""
    tables = materialize(segment_tables(judged, segment), "tables")
    whole = _composed(tables, judged.sparkSession)
    ends = F.filter("table", lambda e: (e["start"] == _NOTHING) & e["end"].isin(*_ENDS))
    best = F.array_min(F.transform(ends, lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"))))
    return whole.select("c", best.alias("best")).select("c", "best.cost", "best.audit")


# ---- edits on the texts ----------------------------------------------------------------------


def repaired_messages(rows: DataFrame, judged: DataFrame, repaired: DataFrame) -> DataFrame:
    """``c, place, edit, role, text`` of every message that a repair leaves, in the order of each conversation.

    A conversation's messages and, before them, its audit are sorted into one stream, which a
    task reads with one message in memory at a time: however long a conversation is, nothing
    of it is collected. The rows of a conversation are neighbours, in order, in one partition.
    """
    schema = pa.schema([("c", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    texts = rows.select("rid", "text").join(judged.select("rid", "c", "position", "role"), "rid")
    stream = texts.select("c", "position", "role", "text").unionByName(
        repaired.select("c", F.lit(-1).cast("long").alias("position"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = stream.repartition(tasks, "c").sortWithinPartitions("c", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edited():
            c, audit, at, state, place = None, "", 0, _NOTHING, 0

            def made(edit, letter, text):
                nonlocal state, place
                state, place = _NEXT[state][letter], place + 1
                return c, place - 1, edit, ROLES[letter], text

            def inserted():
                nonlocal at
                while at < len(audit) and audit[at] == INSERT:
                    at += 1
                    yield made(INSERT, _WANTED[state], "")

            for key, position, role, text in rows_of(batches, "c", "position", "role", "text"):
                if position < 0:
                    c, audit, at, state, place = key, text, 0, _NOTHING, 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit == KEEP:
                        state, place = _NEXT[state][role[0]], place + 1
                        yield c, place - 1, edit, role, text
                    elif edit == REROLE:
                        yield made(edit, _WANTED[state], text)
                yield from inserted()

        yield from batched(edited(), schema, 500)

    return stream.mapInArrow(run, "c string, place long, edit string, role string, text string")


def _digests(messages: DataFrame) -> DataFrame:
    """``c, repaired_sha256`` of ``repaired_messages``, in the same tasks. The hash of a text of any length has one state."""
    schema = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed():
            c, state = None, None
            for key, place, role, text in rows_of(batches, "c", "place", "role", "text"):
                if place == 0:
                    if state is not None:
                        yield c, state.hexdigest()
                    c, state = key, hashlib.sha256()
                state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if state is not None:
                yield c, state.hexdigest()

        yield from batched(hashed(), schema)

    return messages.mapInArrow(run, "c string, repaired_sha256 string")


def _faults_per_conversation(judged: DataFrame) -> DataFrame:
    """``c, gaps, blank, duplicate, truncated``: sums, whose partial results move."""
    turns = judged.groupBy("c", "turn").agg(*(F.sum(F.col(f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("c").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated"))
    )


def _illegal_pairs(judged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``c, illegal``: neighbours whose roles can't follow each other; a window never holds more than a segment and one."""
    first = F.substring("role", 1, 1)
    at = (F.col("position") / segment).cast("long")
    # The last message of a segment is the one before the first of the next, too.
    last = (F.col("position") + 1) % segment == 0
    rows = judged.select("c", "position", first.alias("first"), F.explode(F.when(last, F.array(at, at + 1)).otherwise(F.array(at))).alias("seg"))
    before = F.lag("first").over(Window.partitionBy("c", "seg").orderBy("position"))
    pair = F.concat(before, "first")
    illegal = F.col("_pair").isNotNull() & ~F.col("_pair").isin("su", "ua", "au")
    return rows.select("c", pair.alias("_pair")).groupBy("c").agg(F.sum(illegal.cast("long")).alias("illegal"))


def repair_conversations(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``messages``.

    ``messages`` has ``conv_id, turn, role, text``. ``c`` is ``conversation_key`` of the id: null ids are one
    conversation. Nulls in role and text count as one space; a null turn comes before all others.
    A message's first fault counts: blank, a duplicate of an earlier message (role and text), or
    truncated (the last character that isn't white space doesn't end a sentence). Keeping costs 0, a new role
    1, deleting 2 (blank messages and duplicates have to go), inserting an empty message 5; truncated
    messages that stay cost 5 more. Of the cheapest edits the audit is the least string of K, R, D and I.
    Repeated rows are duplicates. An empty table gives no rows; other columns are not read.
    """
    rows, judged = faults(messages)
    repaired = materialize(repairs(judged, segment), "repairs")
    digests = _digests(repaired_messages(rows, judged, repaired))
    nothing = F.sha2(F.lit(""), 256)
    return (
        repaired.join(_faults_per_conversation(judged), "c").join(_illegal_pairs(judged, segment), "c")
        .join(digests, "c", "left")
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))
    )


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))
