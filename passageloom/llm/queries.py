"""The queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageloom.llm import classifier, conversation_repair, exact_dedup, language_model, line_dedup, line_quality, mixing, near_dedup, pieces, secret_scan, spelling, suffix_dedup, url_filter
from passageloom.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _like(text: str) -> str:
    return text.replace("'", "''")


# A word in DuckDB's regular expressions.
_WORD = r"[^\x20\x09-\x0D]+"


@query
def op1_sentencepiece(spark, d):
    return pieces.encode(table(spark, d, "documents"))


@query
def op2_exact_dedup(spark, d):
    return exact_dedup.deduplicate(table(spark, d, "documents"))


SQL["op2_exact_dedup"] = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM rows JOIN groups USING (text)
"""


@query
def op3_line_quality(spark, d):
    return line_quality.clean_documents(table(spark, d, "documents"), with_text=False)


_noise_word = r"[^\x20\x09-\x0D]*" + line_quality.NOISE + r"[^\x20\x09-\x0D]*"
SQL["op3_line_quality"] = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS w FROM base),
tokens AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
windows AS (
  SELECT rid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win
  FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) > 1 AS again FROM windows WHERE win IS NOT NULL),
covered AS (
  SELECT rid, count(DISTINCT pos + k) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE again GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base),
judged AS (
  SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS nw,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    len([x FOR x IN string_split(replace(line, chr(9), ' '), ' ')
      IF x IN ({", ".join(f"'{s}'" for s in line_quality.SEPARATORS)})]) AS marks,
    len(regexp_extract_all(line, '{_noise_word}')) AS noisy,
    regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS trimmed
  FROM lines WHERE regexp_matches(line, '{_WORD}')),
verdicts AS (
  SELECT rid, line, chars,
    {" OR ".join(f"contains(lowered, '{p}')" for p in line_quality.BOILERPLATE)}
    OR (marks >= 2 AND 5 * marks >= nw)
    OR NOT regexp_matches(trimmed, '{_like(line_quality.CLOSING)}')
    OR (noisy > 0 AND 2 * noisy >= nw) AS bad
  FROM judged),
by_doc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (bad) AS n_removed_lines, coalesce(sum(chars) FILTER (NOT bad), 0) AS kept_word_chars
  FROM verdicts GROUP BY rid),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
    CAST(coalesce(kept_word_chars, 0) AS BIGINT) AS kept_word_chars
  FROM base JOIN words USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN by_doc USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND
  100 * (word_chars - kept_word_chars) <= {line_quality.MAX_LOST_PERCENT} * word_chars AS kept
FROM failed
"""


@query
def op4_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"))


SQL["op4_mixing"] = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS)}][rank % {len(mixing.WEIGHTS)} + 1] AS weight,
    CAST(source_size AS DOUBLE) * {mixing.MAX_EPOCHS} AS cap FROM sources),
rooms AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed),
capped AS (SELECT *, cap * share <= room * weight AS capped FROM rooms),
targets AS (
  SELECT source, source_size, rank, total, CASE WHEN capped THEN cap ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight
      / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM capped),
queued AS (
  SELECT doc_id, size, source_size, target, total, rank, row_number() OVER () AS rid,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
      AS BIGINT) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT rid, size, rank, total, CAST(source_size * epoch + done AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest(range({mixing.MAX_EPOCHS})) AS epoch)
  WHERE size > 0 AND CAST(source_size * epoch + done - size AS DOUBLE) < target),
ordered AS (
  SELECT rid, size, total, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS words FROM copies),
taken AS (SELECT rid, sum(size) AS taken FROM ordered WHERE words <= total GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN taken USING (rid)
"""


@query
def op5_quality_classifier(spark, d):
    labels = table(spark, d, "labels")
    labels = labels.filter(~held_out(labels["doc_id"], 4))
    scored = classifier.classify(table(spark, d, "documents"), labels)
    return scored.select("doc_id", held_out(scored["doc_id"], 4).alias("held_out"), "score", "predicted")


@query
def op6_url_filter(spark, d):
    return url_filter.filter_urls(table(spark, d, "pages"))


_strict, _soft, _weight = url_filter.vocabulary_sql("lowered")
_fits = {
    r: f"((host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}'))" for r in url_filter.RULES
}
_rules = sorted(url_filter.RULES, key=lambda r: -len("".join(r)))
SQL["op6_url_filter"] = rf"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
hits AS (
  SELECT *, CAST({_strict} AS INT) AS strict_hits, CAST({_soft} AS INT) AS soft_hits, {_weight} AS weight FROM split)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_fits[r]} THEN '{''.join(r)}'" for r in _rules)} END AS rule,
  CASE {" ".join(f"WHEN {_fits[r]} THEN '{url_filter.RULES[r]}'" for r in _rules)}
    WHEN strict_hits > 0 OR weight >= {url_filter.REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits
FROM hits
"""


@query
def op7_suffix_dedup(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents"))


@query
def op8_near_dedup(spark, d):
    settings = near_dedup.Settings(percent=85, distance=23)
    return near_dedup.group_near_copies(table(spark, d, "documents"), settings=settings)


@query
def op9_language_model(spark, d):
    docs = table(spark, d, "documents")
    scored = language_model.score_documents(docs, ~held_out(docs["doc_id"], 7))
    return scored.withColumn("held_out", held_out(scored["doc_id"], 7))


@query
def op10_secret_scan(spark, d):
    scanned = secret_scan.scan(table(spark, d, "documents"))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return scanned.select(
        "doc_id",
        *(count(kind) for kind in secret_scan.BASE_KINDS),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
    )


def _rule_sql(number: int, rule: secret_scan.Rule) -> str:
    pattern = _like(("(?i)" if rule.any_case else "") + rule.pattern)
    return f"""
  SELECT rid, {number} AS rank, '{rule.kind}' AS kind, first, first + length(match) AS last
  FROM (
    SELECT rid, match, caught,
      sum(length(gap)) OVER (PARTITION BY rid ORDER BY i)
        + coalesce(sum(length(match)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS first
    FROM (
      SELECT rid, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(matches) AS match, unnest(groups) AS caught
      FROM (
        SELECT rid, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS matches,
          regexp_extract_all(text, '{pattern}', {rule.group}) AS groups
        FROM base WHERE regexp_matches(text, '{pattern}'))))
  WHERE match IS NOT NULL AND length(caught) >= {rule.least}"""


_all_rules = " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secret_scan.RULES))
_is_base = f"kind IN ({', '.join(repr(k) for k in secret_scan.BASE_KINDS)})"
_span = "kind || ':' || CAST(CAST(first AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(last AS BIGINT) AS VARCHAR)"
SQL["op10_secret_scan"] = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
found AS ({_all_rules}),
by_doc AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE_KINDS)},
    string_agg({_span}, ',' ORDER BY first, rank) FILTER ({_is_base}) AS base_spans,
    string_agg({_span}, ',' ORDER BY first, rank) AS spans
  FROM found GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE_KINDS)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM base LEFT JOIN by_doc USING (rid)
"""


@query
def op11_line_dedup(spark, d):
    return line_dedup.drop_repeated_lines(table(spark, d, "documents"), with_text=False)


SQL["op11_line_dedup"] = rf"""
WITH base AS (
  SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS d, string_split(coalesce(text, ''), chr(10)) AS lines,
    row_number() OVER () AS rid FROM documents),
lined AS (SELECT rid, d, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM base),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lined),
judged AS (
  SELECT rid, i, line, length(key) >= {line_dedup.MIN_CHARS} AND d > min(d) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM base JOIN judged USING (rid) GROUP BY rid
"""


@query
def op12_conversation_repair(spark, d):
    messages = table(spark, d, "conversations")
    reports = conversation_repair.repair_conversations(conversation_repair.damage(messages))
    ids = messages.select("conv_id").distinct().withColumn("c", conversation_repair.conversation_key(F.col("conv_id")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(reports, "c", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _crc32(text: str) -> str:
    """crc32 of an ASCII string in DuckDB, beside the column ``t`` of ``crc_table``."""
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)"


_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i))"""
# State before, letter, edit, state after, cost; a truncated message that stays costs more.
_STEPS = ", ".join(
    f"({s}, '{letter.upper() if late else letter}', '{edit}', {after}, {cost + 5 * late})"
    for s, role, after in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
    for letter in "suax"
    for late in (0, 1)
    for edit, cost in (("K", 0), ("R", 1))
    if (edit == "K" and letter == role) or (edit == "R" and role != "s")
)
_INSERTS = "(0, '', 0, 0), (1, '', 1, 0), (2, '', 2, 0), (3, '', 3, 0), (0, 'I', 2, 5), (1, 'I', 2, 5), (2, 'I', 3, 5), (3, 'I', 2, 5), (0, 'II', 3, 10), (1, 'II', 3, 10)"
SQL["op12_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
messages AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM messages, range(2) AS copies(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
first_faults AS (
  SELECT *, NOT regexp_matches(text, '{_WORD}') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), '[.!?]$') AS open_end,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS initial
  FROM placed),
lettered AS (
  SELECT *, CASE WHEN blank OR again THEN 'D' WHEN open_end THEN upper(initial) ELSE initial END AS letter
  FROM first_faults),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND open_end) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(letter, '' ORDER BY i) AS letters
  FROM lettered GROUP BY conv_id),
steps(before, letter, edit, mid, cost) AS (VALUES {_STEPS}),
inserts(mid, more, state, extra) AS (VALUES {_INSERTS}),
walk AS (
  SELECT conv_id, letters, 0 AS i, state, CAST(extra AS BIGINT) AS cost, CAST(more AS VARCHAR) AS audit
  FROM convs, inserts WHERE mid = 0
  UNION ALL
  SELECT conv_id, letters, i, state, cost, audit FROM (
    SELECT w.conv_id, w.letters, w.i + 1 AS i, n.state, w.cost + s.cost + n.extra AS cost, w.audit || s.edit || n.more AS audit
    FROM walk w
    JOIN (SELECT * FROM steps UNION ALL
      SELECT before, letter, 'D', before, 2 FROM range(4) AS b(before), (SELECT unnest(string_split('suaxSUAXD', '')) AS letter)
    ) s ON s.before = w.state AND s.letter = substr(w.letters, w.i + 1, 1)
    JOIN inserts n ON n.mid = s.mid)
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
repaired AS (
  SELECT conv_id, cost, audit FROM walk WHERE i = length(letters) AND state IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
edits AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS k
  FROM repaired WHERE audit <> ''),
placed_edits AS (
  SELECT conv_id, k, edit, count(*) FILTER (edit <> 'I') OVER o AS i, count(*) FILTER (edit <> 'D') OVER o AS place
  FROM edits WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
staying AS (
  SELECT e.conv_id, e.k, e.edit, e.place, CASE WHEN e.edit = 'I' THEN '' ELSE l.text END AS text, l.role,
    bool_or(e.edit = 'K' AND l.initial = 's') OVER (PARTITION BY e.conv_id) AS has_system
  FROM placed_edits e LEFT JOIN lettered l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.i = e.i
  WHERE e.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (place - CAST(has_system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || text, chr(10) ORDER BY k) AS text
  FROM staying GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def op13_spelling_variants(spark, d):
    return spelling.variant_groups(spelling.count_words(table(spark, d, "documents"), damage=True))


# Splits as strings; every word of the table against all others through them.
SQL["op13_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, count(*) AS times, run FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY doc_id, run),
summed AS (
  SELECT id, run, times, hex(encode(id || ':' || run)) AS h, t FROM runs, crc_table),
checked AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM summed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN crc % 199 = 0
      THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM checked)
  WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.MIN_COUNT}),
skips AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after
  FROM words, range(1, 100000) AS r(i) WHERE i <= length(word)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM skips a JOIN skips b USING (i, before, after) WHERE a.word <> b.word
  UNION
  SELECT a.word, a.n, w.word, w.n FROM skips a JOIN words w ON w.word = a.before || a.after
  UNION
  SELECT w.word, w.n, a.word, a.n FROM skips a JOIN words w ON w.word = a.before || a.after),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word, n),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.RATIO} * w.n THEN other END AS form,
    CASE WHEN other_n >= {spelling.RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS place, form FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT word, n, n_near, f.form, form_n, place AS root
FROM formed f JOIN (SELECT word, place FROM chain WHERE form IS NULL) USING (word)
"""
