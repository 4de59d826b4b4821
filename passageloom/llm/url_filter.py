"""Verdicts on URLs: longest host and path rule first, then a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.common import LOWER, batched, rows_of

# (host, path) -> verdict. A rule fits the host and its subdomains if the path starts with its path.
RULES = {
    ("net", "/"): "block",
    ("example.net", "/en/"): "allow",
    ("example.com", "/de/"): "block",
    ("org", "/fr/"): "allow",
}
# One strict term rejects. Soft terms add their weights, each term once; a sum of 1 rejects.
STRICT = ("porn", "xxx", "casino", "viagra", "cialis", "escort", "hentai", "malware", "warez", "phishing")
SOFT = {
    "cheap": 0.5,
    "pills": 0.5,
    "spam": 0.5,
    "farm": 0.5,
    "ads": 0.5,
    "track": 0.5,
    "win": 0.5,
    "bet": 0.5,
    "poker": 0.5,
    "adult": 0.5,
    "sex": 0.5,
    "loan": 0.5,
    "bonus": 0.5,
    "crack": 0.5,
    "torrent": 0.5,
    "free": 0.25,
    "click": 0.25,
    "buy": 0.25,
    "deal": 0.25,
}
REJECT_AT = 1.0

_OUT = pa.schema(
    [
        ("page_id", pa.int64()),
        ("host", pa.string()),
        ("path", pa.string()),
        ("rule", pa.string()),
        ("verdict", pa.string()),
        ("strict_hits", pa.int32()),
        ("soft_hits", pa.int32()),
    ]
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    end = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host.translate(LOWER), tail[:end]


def longest_rule(host: str, path: str, rules: dict[tuple[str, str], str]) -> tuple[str | None, str | None]:
    """The longest fitting rule and its verdict; looks up the host and each parent domain."""
    labels = host.split(".")
    best: tuple[str, str] | None = None
    domains = {".".join(labels[i:]) for i in range(len(labels))}
    for rule in rules:
        if rule[0] in domains and path.startswith(rule[1]):
            if best is None or len("".join(rule)) > len("".join(best)):
                best = rule
    return ("".join(best), rules[best]) if best else (None, None)


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term in terms:
        built.add_word(term, term)
    built.make_automaton()
    return built


def bounded_terms(url: str, built: ahocorasick.Automaton) -> set[str]:
    """Distinct terms of the automaton in ``url`` with no ASCII letter or digit on either side."""
    lowered = url.translate(LOWER)
    inside = lambda i: 0 <= i < len(lowered) and lowered[i].isascii() and lowered[i].isalnum()
    return {term for end, term in built.iter(lowered) if not inside(end - len(term)) and not inside(end + 1)}


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: dict[tuple[str, str], str] = RULES,
    strict: Iterable[str] = STRICT,
    soft: dict[str, float] = SOFT,
    reject_at: float = REJECT_AT,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_hits, soft_hits``, one row per page, without a shuffle.

    Null urls and urls without ``://`` have empty host and path and fit no
    rule; their text is still searched for terms. Equal rows are judged alike
    and all stay; an empty table gives none; other columns are not read.
    """
    strict_terms, soft_terms = set(strict), dict(soft)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton([*strict_terms, *soft_terms])

        def rows():
            for page, url in rows_of(batches, "page_id", "url"):
                host, path = split_url(url)
                rule, verdict = longest_rule(host, path, rules)
                found = bounded_terms(url or "", built)
                hard = found & strict_terms
                weight = sum(soft_terms[t] for t in found - strict_terms)
                if verdict is None:
                    verdict = "block" if hard or weight >= reject_at else "allow"
                yield page, host, path, rule, verdict, len(hard), len(found - strict_terms)

        yield from batched(rows(), _OUT)

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return chosen.mapInArrow(
        judge,
        "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int",
    )


def vocabulary_sql(column: str, strict: Iterable[str] = STRICT, soft: dict[str, float] = SOFT) -> tuple[str, str, str]:
    """SQL for the number of strict hits, of soft hits, and for the sum of soft weights."""

    def hit(term: str) -> str:
        return f"CAST(regexp_matches({column}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INT)"

    return (
        " + ".join(hit(t) for t in strict),
        " + ".join(hit(t) for t in soft),
        " + ".join(f"{w} * {hit(t)}" for t, w in soft.items()),
    )
