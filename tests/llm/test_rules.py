"""URL verdicts, line rules and secrets."""

import random
import re

import pytest

from passageloom.llm import line_quality, secret_scan, url_filter


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("casino", "", "", None, "block"),
        ("http://A.Net/x?y", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://m.example.net/en/1#t", "m.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://casino.org/fr/1", "casino.org", "/fr/1", "org/fr/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.com/casinos", "x.com", "/casinos", None, "allow"),
        ("http://x.com/cheap", "x.com", "/cheap", None, "allow"),
        ("http://x.com/cheap-cheap", "x.com", "/cheap-cheap", None, "allow"),
        ("http://x.com/CHEAP/pills", "x.com", "/CHEAP/pills", None, "block"),
        ("http://x.com/free/click/buy", "x.com", "/free/click/buy", None, "allow"),
        ("http://x.com/free/click/buy/deal", "x.com", "/free/click/buy/deal", None, "block"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    row = url_filter.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_words_that_repeat():
    assert line_quality.repeated_words(b"a a a a".split()) == 4
    assert line_quality.repeated_words(b"a b c d a b c".split()) == 6
    assert line_quality.repeated_words(b"a b".split()) == 0


@pytest.mark.parametrize(
    "line, rule",
    [
        ("A plain sentence that ends as it should.", None),
        ("Home | News | About us.", "navigation"),
        ("no mark at the end", "punctuation"),
        ("the&&& of%%% and*** to$$$.", "punctuation"),
        ("Licensed under the Some License, Version 2.", "boilerplate"),
    ],
)
def test_lines(line, rule):
    assert line_quality.line_fails(line, len(line.split())) == rule


def test_cleaned_text_and_clean_documents(spark):
    rng = random.Random(1)
    good = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) + "." for _ in range(10))
    rows = [(1, good), (2, good + "\nHome | News | Mail"), (3, "Home | News | Mail\n" * 40 + good)]
    out = {r.doc_id: r for r in line_quality.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept and out[2].kept and out[1].text == out[2].text == good
    assert not out[3].kept and out[3].n_removed_lines == 40


def test_trigram_queries():
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind not in ("hex", "github"))
    assert set(secret_scan.trigram_query("abcd?e")) == {frozenset({"abc", "bce"}), frozenset({"abc", "bcd", "cde"})}
    assert set(secret_scan.trigram_query("abcd|(x|yz)wvu")) == {frozenset({"abc", "bcd"}), frozenset({"wvu", "xwv"}), frozenset({"yzw", "zwv", "wvu"})}
    assert secret_scan.trigram_query("abc|de") == []


def python_spans(text, rule):
    flags = re.IGNORECASE | re.ASCII if rule.any_case else re.ASCII
    for m in re.finditer(rule.pattern, text, flags):
        if len(m.group(rule.group)) >= rule.least:
            yield m.start(), m.end()


def test_secrets_equal_a_plain_search(spark, docs, rows):
    more = [
        "token=token:abcdefgh1", "PassWD : \"aaaaaaaa\" api-key=1 apikey='12345678' api_key=é", "AKIA1 AKIAAAAAAAAAAAAA AKIAAKIAAKIAAKIA",
        "☃ " + "0123456789abcdef" * 3 + "G" + "f" * 31, "ghp_" + "a" * 40, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----",
        "secret" * 5 + "=" + "=" * 9, "eyJabcdefgh1.eyJabcdefgh1.abcdefgh1",
    ]
    table = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(more)]
    found = secret_scan.scan(spark.createDataFrame(table, "doc_id long, text string"))
    got = found.select("doc_id", secret_scan.joined(found["found"]).alias("spans")).collect()
    want = []
    for doc, text in table:
        spans = [(a, k, b, r.kind) for k, r in enumerate(secret_scan.RULES) for a, b in python_spans(text or "", r)]
        want.append((doc, ",".join(f"{kind}:{a}:{b}" for a, k, b, kind in sorted(spans))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_scan_is_native(docs, plan):
    assert not any(word in plan(secret_scan.scan(docs)) for word in ("Python", "Pandas", "Arrow"))
