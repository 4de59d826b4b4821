"""Secrets in texts: a trigram index gives candidates, regular expressions confirm them; DataFrame operations only.

Every rule is a regular expression with the strings one of which each of its
matches must hold, derived from it by hand of its literals: a rule is an OR of
ANDs of trigrams. The index has the documents of every trigram that some rule
asks for, part by part. A rule's candidates are the intersections of its posting
lists; a rule without mandatory trigrams has every document as a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageloom.llm.parts import numbered, store_parts
from passageloom.session import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax of Java; ``group`` is what has to have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


# The patterns and lengths of the first three are fixed values of the contract.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")


def _alternatives(pattern: str) -> list[str]:
    """The parts of ``pattern`` between the bars that are outside groups and classes."""
    parts, depth, i, start = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        depth += {"(": 1, ")": -1}.get(c, 0)
        i += 1
    return [*parts, pattern[start:]]


def _literals(pattern: str) -> list[list[str]]:
    """For each alternative way to match, the literal strings in it."""
    return [way for part in _alternatives(pattern) for way in _ways(part)]


def _ways(pattern: str) -> list[list[str]]:
    """The same for a pattern without bars outside groups.

    Understands groups of alternatives, optional characters and character
    classes; whatever else may stand for any text, it takes for a gap.
    """
    ways: list[list[str]] = [[""]]

    def add(literal: str) -> None:
        for way in ways:
            way[-1] += literal

    def gap() -> None:
        for way in ways:
            way.append("")

    i = 0
    while i < len(pattern):
        c = pattern[i]
        after = pattern[i + 1 : i + 2]
        if c == "(":
            end = i + 1
            depth = 1
            while depth:
                if pattern[end] == "[":
                    end = pattern.index("]", end + 1)
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1
            inner, optional = pattern[i + 1 : end - 1], pattern[end : end + 1] in ("?", "*")
            if "(" in inner or optional or "[" in inner:
                gap()
            else:
                options = _literals(inner)
                ways = [
                    [*way[:-1], way[-1] + option[0], *option[1:]] for way in ways for option in options
                ]
            if pattern[end : end + 1] in ("?", "*", "+", "{"):
                gap()
            i = end
            continue
        if c == "[":
            end = pattern.index("]", i + 2)
            gap()
            i = end + 1
        elif c == "\\":
            end = i + 4 if after == "x" else i + 2
            literal = chr(int(pattern[i + 2 : end], 16)) if after == "x" else after
            if pattern[end : end + 1] in ("?", "*", "+", "{") or (literal.isalnum() and after != "x"):
                gap()
            else:
                add(literal)
            i = end
        elif after == "?":
            # With and without the character.
            ways = [[*way[:-1], way[-1] + x] for way in ways for x in (c, "")]
            i += 2
            continue
        elif after in ("*", "{"):
            gap()
            i += 1
        elif c in "*+?{}.^$|":
            gap()
            i = pattern.index("}", i) + 1 if c == "{" else i + 1
            continue
        else:
            add(c)
            i += 1
            continue
        if pattern[i : i + 1] in ("?", "*", "+"):
            i += 1
        elif pattern[i : i + 1] == "{":
            i = pattern.index("}", i) + 1
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match has; empty if some way to match has none."""
    ways = set()
    for way in _literals(pattern):
        lowered = [literal.lower() for literal in way]
        grams = frozenset(x[i : i + 3] for x in lowered for i in range(len(x) - 2) if x.isascii())
        if not grams:
            return []
        ways.add(grams)
    # A way whose trigrams include another's adds nothing.
    return sorted((w for w in ways if not any(o < w for o in ways)), key=sorted)


def _spans(text: Column, rule: Rule) -> Column:
    """``kind, start, end`` of the leftmost non-overlapping matches that are long enough, in code points.

    Splitting a text at the matches gives what lies between them; the lengths of
    both, added up in turn, are the places.
    """
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), checked.alias("group"))
    none = F.array().cast("array<struct<start:int,end:int,keep:boolean>>")

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["match"])
        found = F.struct(start.alias("start"), end.alias("end"), (F.length(row["group"]) >= rule.least).alias("keep"))
        return F.struct(
            F.when(row["match"].isNull(), state["at"]).otherwise(end).alias("at"),
            F.when(row["match"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(found))).alias("spans"),
        )

    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    spans = F.filter(F.aggregate(rows, first, step)["spans"], lambda s: s["keep"])
    return F.transform(spans, lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``doc_id, found`` per row: an array of ``kind, start, end`` in the order of start, then of ``rules``.

    Every rule is searched in whole texts and on its own: its matches don't
    overlap each other, those of different rules may. A null or empty text has
    none. Null ids and repeated rows stay; an empty table gives no rows; other
    columns are not read. Texts are stored once and never shuffled.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = store_parts(numbered(chosen), "texts")

    queries = [trigram_query(rule.pattern) for rule in rules]
    grams = sorted({gram for query in queries for way in query for gram in way})
    # Postings: the places of a part that have the trigram. A text is folded once for all of them.
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.filter(F.array(*(F.lit(g) for g in grams)), lambda g: F.contains(F.col("folded"), g))
    postings = (
        rows.select("part", "pos", folded.alias("folded"))
        .select("part", "pos", F.explode(has).alias("gram"))
        .groupBy("part", "gram").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    )
    # One row per part; a part is bounded by the size of an input split.
    lists = postings.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("gram", "places"))).alias("index"))
    empty = F.array().cast("array<bigint>")

    def candidates(query: list[frozenset[str]]) -> Column:
        def list_of(gram: str) -> Column:
            return F.coalesce(F.element_at("index", F.lit(gram)), empty)

        ways = [reduce(F.array_intersect, (list_of(g) for g in sorted(way))) for way in query]
        return reduce(F.array_union, ways)

    # Per part, a string with one digit per place for every indexed rule: 1 where the place is a candidate.
    marks = {}
    for number, query in enumerate(queries):
        if query:
            places = F.array_sort(candidates(query))
            gaps = F.zip_with(places, F.concat(F.array(F.lit(-1).cast("bigint")), places), lambda a, b: a - b - 1)
            digits = F.transform(F.filter(gaps, lambda g: g.isNotNull()), lambda g: F.concat(F.repeat(F.lit("0"), g.cast("int")), F.lit("1")))
            marks[f"_m{number}"] = F.array_join(digits, "")
    marked = materialize(lists.select("part", *(column.alias(name) for name, column in marks.items())), "candidates")

    met = rows.join(marked, "part", "left")
    found = []
    for number, (rule, query) in enumerate(zip(rules, queries)):
        place = (F.col("pos") + 1).cast("int")
        candidate = F.substring(f"_m{number}", place, F.lit(1)) == "1" if query else F.lit(True)
        # A search for one match is cheaper than the spans, which few texts have.
        pattern = ("(?i)" if rule.any_case else "") + rule.pattern
        if rule.group == 0 and rule.least and pattern.endswith("+"):
            pattern = f"{pattern[:-1]}{{{rule.least - _fixed(rule.pattern)},}}"
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        found.append(F.when(candidate & F.col("text").rlike(pattern), _spans(F.col("text"), rule)).otherwise(none))
    kinds = F.array(*(F.lit(r.kind) for r in rules))

    def order(a: Column, b: Column) -> Column:
        first = F.array_position(kinds, a["kind"]) - F.array_position(kinds, b["kind"])
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(first.cast("int"))

    return met.select("doc_id", F.array_sort(F.concat(*found), order).alias("found"))


def _fixed(pattern: str) -> int:
    """Characters before the last, repeated class of a pattern without other repeats."""
    return len(re.sub(r"\[[^]]*\]", "", pattern.removesuffix("+")))


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end``, with commas between."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
