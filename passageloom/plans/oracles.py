"""The same queries as SQL, for comparison on the same tables."""

from __future__ import annotations

from passageloom.operators.prompts import ANSWER_INSTRUCTIONS, EXPAND_INSTRUCTIONS
from passageloom.plans import registry as r
from passageloom.plans.answers import ANSWER_WORDS, CANNED, FAILED, MISSING, NOTE, NOTE_KEYWORD, QUESTION_WORDS
from passageloom.plans.stem_sql import stem_steps

# White space and punctuation rules, in RE2 notation.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MTEVAL = [
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# Documents and chunks

_FILES = """files AS MATERIALIZED (
  SELECT doc_id, source || '/' || doc_id || '.txt' AS relative_path, lang AS language,
         translate(text, chr(10), ' ') AS text
  FROM documents)"""

_WORD_CHUNKS = f"""split AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '') AS ws FROM files),
words AS MATERIALIZED (
  SELECT doc_id, i, n, en, en - length(w) AS st
  FROM (SELECT doc_id, i, w, n,
               (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS en
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split))),
ends AS MATERIALIZED (
  SELECT a.doc_id, a.i AS a, a.n, b.i AS b, b.en
  FROM words a ASOF JOIN words b ON a.doc_id = b.doc_id AND a.st + 2000 >= b.en),
steps AS MATERIALIZED (
  SELECT e.doc_id, e.a, e.b, e.n, greatest(e.a + 1, least(e.b + 1, coalesce(s.i, e.b + 1))) AS following
  FROM ends e ASOF LEFT JOIN words s ON e.doc_id = s.doc_id AND e.en - 300 <= s.st),
walk AS (
  SELECT doc_id, 0 AS chunk_no, a, b, n, following FROM steps WHERE a = 1
  UNION ALL
  SELECT s.doc_id, w.chunk_no + 1, s.a, s.b, s.n, s.following
  FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.a = w.following WHERE w.b < w.n),
pieces AS MATERIALIZED (
  SELECT walk.doc_id, chunk_no::INTEGER AS chunk_no, array_to_string(list_slice(ws, a, b), ' ') AS chunk
  FROM walk JOIN split ON walk.doc_id = split.doc_id)"""

_CHUNKS = """chunks AS MATERIALIZED (
  SELECT p.doc_id, p.chunk_no, relative_path, 'files://corpus/' || relative_path AS file_url,
         relative_path || ': ' || p.chunk AS chunk, language
  FROM pieces p JOIN files f ON p.doc_id = f.doc_id)"""

_CORPUS = (_FILES, _WORD_CHUNKS, _CHUNKS)

# Ranked search

_POSTINGS = r"""lengths AS MATERIALIZED (
  SELECT doc_id, chunk_no, language, regexp_extract_all(lower(chunk), '[\p{L}\p{N}]+') AS toks FROM chunks),
postings AS MATERIALIZED (
  SELECT doc_id, chunk_no, language, term, dl, count(*) AS tf
  FROM (SELECT doc_id, chunk_no, language, unnest(toks) AS term, len(toks) AS dl FROM lengths)
  GROUP BY ALL),
freqs AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def _search(queries: str, condition: str = "true") -> str:
    return rf"""asked AS MATERIALIZED ({queries}),
asked_terms AS MATERIALIZED (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM asked),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS mean FROM lengths),
scored AS (
  SELECT query_id, doc_id, chunk_no,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 4) AS score
  FROM asked_terms JOIN postings USING (term) JOIN freqs USING (term), corpus
  WHERE {condition}
  GROUP BY ALL),
hits AS MATERIALIZED (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no)::INTEGER AS rank,
         doc_id, chunk_no, score
  FROM scored QUALIFY rank <= 5)"""


_ALL_ASKED = """SELECT conv_id || '/' || turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user' """
_HITS = (*_CORPUS, _POSTINGS, _search(_ALL_ASKED))
_CONTEXT = """contexts AS (
  SELECT query_id, string_agg('Context document ' || rank || ': ' || chunk || ' ' || chr(10) || chr(10), '' ORDER BY rank) AS context
  FROM hits JOIN chunks USING (doc_id, chunk_no) GROUP BY query_id)"""

# Conversations

_QA = """qa AS (
  SELECT conv_id, turn, text AS question, next_text AS answer, next_turn
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lead(turn) OVER w AS next_turn
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""
_PLACES = """places AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM messages)"""


def _histories(asked: str) -> str:
    return f"""histories AS (
  SELECT query_id, string_agg(m.role || ': ' || m.text, chr(10) ORDER BY m.turn) AS history
  FROM {asked} q JOIN places p USING (conv_id, turn) JOIN places m ON m.conv_id = q.conv_id AND m.place BETWEEN p.place - 4 AND p.place
  GROUP BY query_id)"""


_ASKED_HISTORY = (
    f"last_asked AS ({_ALL_ASKED}),\nmessages AS (SELECT * FROM conversations),\n{_PLACES},\n" + _histories("last_asked")
)


def _first_words(text: str, n: int) -> str:
    words = f"list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda w: w <> '')"
    return f"CASE WHEN len({words}) > {n} THEN array_to_string({words}[1:{n}], ' ') ELSE {text} END"


def _section(tag: str, body: str) -> str:
    return f"'<{tag}>' || chr(10) || {body} || chr(10) || '</{tag}>' || chr(10)"


def _log(numbered_from: str = "qa", first: str = "", second: str = "next_turn") -> str:
    return f"""SELECT row_number() OVER (ORDER BY {first} ts, conv_id, turn) AS id, question, answer,
       timezone('America/Bogota', timezone('America/Los_Angeles', ts)) AS logged_at
FROM (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(conv_id) + to_seconds({second}) AS ts FROM {numbered_from})"""


# Evaluation

_PAIRS = _QA + """,
pairs AS MATERIALIZED (
  SELECT conv_id || '/' || turn AS pair_id, question AS reference, answer AS candidate FROM qa)"""


def _mteval(column: str) -> str:
    text = f"' ' || {column} || ' '"
    for pattern, replacement in _MTEVAL:
        text = f"regexp_replace({text}, {_lit(pattern)}, {_lit(replacement)}, 'g')"
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda t: t <> '')"


def _unicode(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+')"


def _toks(prefix: str, tokenize) -> str:
    return f"""{prefix}_toks AS MATERIALIZED (
  SELECT pair_id, {tokenize('candidate')} AS c, {tokenize('reference')} AS r FROM pairs)"""


def _overlap(prefix: str, tokenize=None) -> str:
    """Tokens and overlaps of n-grams; without ``tokenize`` the tokens are there already."""
    toks = _toks(prefix, tokenize) + ",\n" if tokenize else ""
    return toks + f"""{prefix}_grams AS (
  SELECT pair_id, n, gram, sum(is_c) AS c, sum(1 - is_c) AS r
  FROM (SELECT pair_id, n, is_c, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS gram
        FROM (SELECT pair_id, 1 AS is_c, c AS t FROM {prefix}_toks UNION ALL SELECT pair_id, 0, r FROM {prefix}_toks),
             (SELECT unnest([1, 2, 3, 4]) AS n))
  GROUP BY ALL),
{prefix}_sums AS MATERIALIZED (
  SELECT pair_id, o.n, coalesce(sum(least(c, r)), 0)::DOUBLE AS hit, coalesce(sum(c), 0)::DOUBLE AS c, coalesce(sum(r), 0)::DOUBLE AS r
  FROM (SELECT pair_id, n FROM pairs, (SELECT unnest([1, 2, 3, 4]) AS n)) o LEFT JOIN {prefix}_grams USING (pair_id, n)
  GROUP BY ALL)"""


def _bleu(prefix: str) -> str:
    return f"""bleus AS MATERIALIZED (
  SELECT pair_id, CASE WHEN sum(hit) = 0 THEN 0.0 ELSE
      CASE WHEN max(c) FILTER (n = 1) < max(r) FILTER (n = 1)
           THEN exp(1 - max(r) FILTER (n = 1) / max(c) FILTER (n = 1)) ELSE 1.0 END
      * exp(sum(CASE WHEN c = 0 THEN 0 WHEN hit = 0 THEN ln(100 / (pow(2, z) * c)) ELSE ln(100 * hit / c) END)
            / count(*) FILTER (c > 0)) END AS bleu
  FROM (SELECT *, sum(CASE WHEN c > 0 AND hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY n) AS z FROM {prefix}_sums)
  GROUP BY pair_id)"""


def _rouge(n: int) -> str:
    return f"""rouges{n} AS (
  SELECT pair_id, CASE WHEN c + r > 0 THEN 2 * hit / (c + r) ELSE 0.0 END AS rouge{n} FROM u_sums WHERE n = {n})"""


# One row of the table of subsequence lengths per step, for all pairs at once:
# a row is the running maximum of its cells, so one window gives it whole.
_ROUGE_L = """cells(pair_id, i, j, v) AS (
  SELECT pair_id, 0, unnest(range(1, len(r) + 1)), 0 FROM u_toks
  UNION ALL
  SELECT pair_id, i, j, max(cell) OVER (PARTITION BY pair_id ORDER BY j)::INTEGER
  FROM (SELECT p.pair_id, p.i + 1 AS i, p.j,
               CASE WHEN t.c[p.i + 1] = t.r[p.j] THEN coalesce(lag(p.v) OVER (PARTITION BY p.pair_id ORDER BY p.j), 0) + 1 ELSE p.v END AS cell
        FROM cells p JOIN u_toks t ON p.pair_id = t.pair_id WHERE p.i < len(t.c))),
common AS (
  SELECT u.pair_id, len(u.c) AS c, len(u.r) AS r, coalesce(max(v), 0) AS lcs
  FROM u_toks u LEFT JOIN cells x ON x.pair_id = u.pair_id AND x.i = len(u.c)
  GROUP BY ALL),
rouges_l AS MATERIALIZED (SELECT pair_id, CASE WHEN c + r > 0 THEN 2 * lcs / (c + r) ELSE 0.0 END AS rouge_l FROM common)"""

_ASCII = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
# Tokens of more than three characters are stemmed.
_STEMMED = (
    *stem_steps(
        f"SELECT DISTINCT unnest({_ASCII.format('t')}) AS token"
        " FROM (SELECT reference AS t FROM pairs UNION ALL SELECT candidate FROM pairs)"
    ),
    f"""sides AS (
  SELECT pair_id, 'c' AS side, {_ASCII.format('candidate')} AS toks FROM pairs
  UNION ALL SELECT pair_id, 'r', {_ASCII.format('reference')} FROM pairs),
stemmed AS MATERIALIZED (
  SELECT pair_id, side, list(CASE WHEN length(token) > 3 THEN stem ELSE token END ORDER BY i) AS toks
  FROM (SELECT pair_id, side, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM sides) JOIN stems USING (token)
  GROUP BY ALL),
u_toks AS MATERIALIZED (
  SELECT p.pair_id, coalesce(c.toks, []) AS c, coalesce(r.toks, []) AS r FROM pairs p
  LEFT JOIN stemmed c ON c.pair_id = p.pair_id AND c.side = 'c' LEFT JOIN stemmed r ON r.pair_id = p.pair_id AND r.side = 'r')""",
)
_STEMMED_SCORES = (_PAIRS, _overlap("m", _mteval), _bleu("m"), *_STEMMED, _overlap("u"), _rouge(1), _rouge(2), _ROUGE_L)
_SCORES = (_PAIRS, _overlap("m", _mteval), _bleu("m"), _overlap("u", _unicode), _rouge(1), _rouge(2), _ROUGE_L)
_ALL_SCORES = """scores AS MATERIALIZED (
  SELECT p.*, bleu, rouge1, rouge2, rouge_l
  FROM pairs p JOIN bleus USING (pair_id) JOIN rouges1 USING (pair_id) JOIN rouges2 USING (pair_id) JOIN rouges_l USING (pair_id))"""
_PAIR_SCORES = """SELECT pair_id, reference, candidate, round(bleu, 4) AS bleu, round(rouge1, 4) AS rouge1,
       round(rouge2, 4) AS rouge2, round(rouge_l, 4) AS rouge_l FROM scores"""
_DESCRIBED = """count({0}) AS count, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, {1} AS min,
       round(quantile_cont({0}, 0.25), 4) AS q25, round(quantile_cont({0}, 0.5), 4) AS q50,
       round(quantile_cont({0}, 0.75), 4) AS q75, {2} AS max"""


def _describe_score(name: str) -> str:
    return f"SELECT '{name}' AS metric, " + _DESCRIBED.format(name, f"round(min({name}), 4)", f"round(max({name}), 4)") + " FROM scores"


def _case(value: str, replies: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in replies.items())
    return f"CASE {value} {whens} END"


# From open questions to the log

_OPEN = f"""messages AS MATERIALIZED (
  SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {_first_words('text', QUESTION_WORDS)} ELSE text END AS text
  FROM conversations),
{_PLACES},
opened AS MATERIALIZED (
  SELECT conv_id || '/' || turn AS query_id, conv_id, turn, text AS asked, replace(text, '\'\'', '') AS question,
         {_case(f"lower(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'))", CANNED)} AS canned
  FROM places WHERE role = 'user' AND next_role IS DISTINCT FROM 'assistant')"""
_DRAFTS = (
    *_CORPUS, _POSTINGS, _OPEN, _search("SELECT query_id, question AS text FROM opened WHERE canned IS NULL"), _CONTEXT,
    _histories("opened"),
    f"""listed AS (
  SELECT query_id, chr(10) || chr(10) || '**References:**' || chr(10)
         || string_agg('- ' || relative_path || chr(10), '' ORDER BY rank) AS refs
  FROM hits JOIN chunks USING (doc_id, chunk_no) GROUP BY query_id),
prompted AS (
  SELECT *, CASE WHEN canned IS NULL THEN '[INST]' || chr(10) || {_lit(ANSWER_INSTRUCTIONS)} || chr(10)
       || {_section('chat_history', "coalesce(history, '')")} || {_section('context', "coalesce(context, '')")}
       || {_section('question', 'question')} || '[/INST]' || chr(10) || 'Answer:' || chr(10) END AS prompt
  FROM opened LEFT JOIN contexts USING (query_id) LEFT JOIN histories USING (query_id) LEFT JOIN listed USING (query_id)),
drafts AS MATERIALIZED (
  SELECT query_id, conv_id, turn, asked, question, canned, prompt, coalesce(refs, '') AS "references",
         '{{"model":"{r.MODEL}","messages":[{{"role":"user","content":' || to_json(prompt)::VARCHAR
         || '}}],"options":{{"temperature":1.0}}}}' AS request FROM prompted)""",
)
_FINISHED = (
    *_DRAFTS,
    f"""said AS (SELECT conv_id, arg_min(text, turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
answered AS (
  SELECT *, CASE conv_id % 4 WHEN 1 THEN {_lit(FAILED)} WHEN 2 THEN {_lit(MISSING)} WHEN 3 THEN {_lit(MISSING)}
    ELSE coalesce(said, 'no message') END AS raw FROM drafts LEFT JOIN said USING (conv_id)),
finished AS MATERIALIZED (
  SELECT query_id, conv_id, turn, question, "references",
         coalesce(canned, replace({_first_words('raw', ANSWER_WORDS)}, '$', '\\$')
           || CASE WHEN contains(lower(asked), {_lit(NOTE_KEYWORD)}) THEN {_lit(NOTE)} ELSE '' END) AS answer
  FROM answered)""",
)


_COUNTED_TERMS = "SELECT term, count(*) AS df, count(*) AS chunks, sum(tf)::BIGINT AS tf FROM postings GROUP BY term"

SQL: dict[str, str] = {
    "src_listing": "SELECT DISTINCT source FROM documents",
    "src_extension": "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html'",
    "src_latest": """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "source_changes": """WITH before AS (
  SELECT user_id, ts, event_id FROM events WHERE ts < TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
after AS (
  SELECT user_id, ts, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CASE WHEN b.event_id IS NULL THEN 'added' WHEN a.event_id IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM before b FULL JOIN after a USING (user_id)
WHERE (b.ts, b.event_id) IS DISTINCT FROM (a.ts, a.event_id)""",
    "scan_chunks": _with(*_CORPUS)
    + "SELECT doc_id, chunk_no, relative_path, language, length(chunk)::INTEGER AS chunk_chars FROM chunks",
    "eval_pairs": _with(_PAIRS) + "SELECT * FROM pairs",
    "chunk_table": _with(*_CORPUS) + "SELECT doc_id, chunk_no, relative_path, file_url, chunk, language FROM chunks",
    "activity_log": _with(_QA) + _log(first="((coalesce(conv_id, 0) % 2) + 2) % 2,"),
    "activity_stream": _with(_QA) + _log(),
    "retrieve_filtered": _with(*_CORPUS)
    + f"SELECT chunk, file_url, relative_path FROM chunks WHERE language = {_lit(r.LANGUAGE)} ORDER BY doc_id, chunk_no LIMIT 5",
    "filter_dsl": f"SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = {_lit(r.LANGUAGE)} AND source = 'src1'",
    "clean_text": "SELECT doc_id, translate(text, chr(10), ' ') AS cleaned FROM documents",
    "assemble_pages": f"""SELECT relative_path,
       CASE WHEN max(failed) IS NULL THEN '' ELSE 'Unable to Extract' END
       || coalesce(string_agg(translate(text, chr(10), ' '), '' ORDER BY turn) FILTER (failed IS NULL OR turn > failed), '') AS text
FROM (SELECT conv_id AS relative_path, turn, text,
             max(turn) FILTER (turn % 5 = 3) OVER (PARTITION BY conv_id) AS failed FROM conversations)
GROUP BY relative_path""",
    "chunk_words": _with(_FILES, _WORD_CHUNKS) + "SELECT doc_id, chunk_no, chunk FROM pieces",
    "chunk_chars": _with(_FILES)
    + """SELECT doc_id, i::INTEGER AS chunk_no, substring(text, (i * 1700 + 1)::INTEGER, 2000) AS chunk
FROM (SELECT doc_id, text, unnest(range(1 + ceil(greatest(0, length(text) - 2000) / 1700)::BIGINT)) AS i
      FROM files WHERE length(text) > 0)""",
    "search_topk": _with(*_HITS) + "SELECT query_id, rank, doc_id, chunk_no, score FROM hits",
    "search_filtered": _with(
        *_CORPUS, _POSTINGS, _search("SELECT item_id AS query_id, text FROM benchmark", f"language = {_lit(r.LANGUAGE)}")
    )
    + "SELECT query_id, rank, doc_id, chunk_no, score FROM hits",
    "search_pruned": _with(*_CORPUS, _POSTINGS, _search("SELECT item_id AS query_id, text FROM benchmark")) + "SELECT query_id, rank, doc_id, chunk_no, score FROM hits",
    "context_block": _with(*_HITS, _CONTEXT) + "SELECT query_id, context FROM contexts",
    "references": _with(*_HITS)
    + """SELECT query_id, chr(10) || chr(10) || '**References:**' || chr(10)
       || string_agg('- ' || relative_path || chr(10), '' ORDER BY rank) AS "references"
FROM hits JOIN chunks USING (doc_id, chunk_no) GROUP BY query_id""",
    "index_refresh": _with(*_CORPUS, _POSTINGS) + _COUNTED_TERMS,
    "index_merged": _with(*_CORPUS, _POSTINGS) + _COUNTED_TERMS,
    "history_last_n": """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""",
    "history_without_current": """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) BETWEEN 2 AND 6""",
    "history_since_clear": """SELECT conv_id, turn, role, text FROM conversations
QUALIFY turn > coalesce(max(turn) FILTER (role = 'system') OVER (PARTITION BY conv_id), -1)""",
    "history_text": """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)
GROUP BY conv_id""",
    "qa_pairs": _with(_QA) + "SELECT conv_id, turn, question, answer FROM qa",
    "limit_words": f"""SELECT conv_id, turn,
       CASE WHEN len(ws) > 10 THEN array_to_string(ws[1:10], ' ') ELSE text END AS limited
FROM (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '') AS ws FROM conversations)""",
    "route_canned": f"""WITH normal AS (
  SELECT conv_id, turn, lower(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS phrase FROM conversations),
phrases AS (
  SELECT phrase, row_number() OVER (ORDER BY length(phrase), phrase) AS n FROM (SELECT DISTINCT phrase FROM normal))
SELECT conv_id, turn, [{", ".join(map(_lit, r.REPLIES))}][n] AS canned FROM normal
LEFT JOIN (SELECT * FROM phrases WHERE n <= {len(r.REPLIES)}) USING (phrase)""",
    "append_note": _with(_QA)
    + f"SELECT conv_id, turn, answer || CASE WHEN contains(lower(question), {_lit(r.KEYWORD)}) THEN {_lit(r.NOTE)} ELSE '' END AS answer FROM qa",
    "escape_text": """SELECT conv_id, turn, replace(t, '''', '') AS unquoted, replace(t, '$', '\\$') AS escaped
FROM (SELECT conv_id, turn, 'it''s $5 ''now'': ' || text AS t FROM conversations)""",
    "extract_json": "SELECT event_id, json_extract_string(props, '$.k') AS answer FROM events",
    "fallback_answer": f"""SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN {_lit(r.FALLBACK)}
       ELSE coalesce(json_extract_string(props, '$.k'), {_lit(r.FALLBACK)}) END AS answer FROM events""",
    "expansion_prompt": _with(_ASKED_HISTORY)
    + f"""SELECT query_id, '[INST]' || chr(10) || {_lit(EXPAND_INSTRUCTIONS)} || chr(10)
       || {_section('chat_history', "coalesce(history, '')")} || {_section('question', 'text')} || '[/INST]' || chr(10) AS prompt
FROM last_asked LEFT JOIN histories USING (query_id)""",
    "answer_prompt": _with(*_HITS, _CONTEXT, _ASKED_HISTORY)
    + f"""SELECT query_id, text AS question, '[INST]' || chr(10) || {_lit(ANSWER_INSTRUCTIONS)} || chr(10)
       || {_section('chat_history', "coalesce(history, '')")} || {_section('context', "coalesce(context, '')")}
       || {_section('question', 'text')} || '[/INST]' || chr(10) || 'Answer:' || chr(10) AS prompt
FROM last_asked LEFT JOIN contexts USING (query_id) LEFT JOIN histories USING (query_id)""",
    "open_questions": _with(_OPEN) + "SELECT query_id, conv_id, turn, asked, question, canned FROM opened",
    "draft_answers": _with(*_DRAFTS) + "SELECT * FROM drafts",
    "live_drafts": _with(*(part.replace(" AND next_role IS DISTINCT FROM 'assistant'", "") for part in _DRAFTS)) + "SELECT * FROM drafts",
    "finish_answers": _with(*_FINISHED) + "SELECT * FROM finished",
    "answer_log": _with(*_FINISHED) + _log("finished", "((coalesce(conv_id, 0) % 2) + 2) % 2,", "turn"),
    "filtered_context": _with(*_CORPUS)
    + f"""SELECT query_id, context, refs AS "references" FROM (
  SELECT string_agg('Context document ' || rank || ': ' || chunk || ' ' || chr(10) || chr(10), '' ORDER BY rank) AS context,
         chr(10) || chr(10) || '**References:**' || chr(10) || string_agg('- ' || relative_path || chr(10), '' ORDER BY rank) AS refs
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_no) AS rank FROM chunks WHERE language = {_lit(r.LANGUAGE)}
        QUALIFY rank <= 5)), ({_ALL_ASKED})""",
    "paged_chunks": _with(
        f"""files AS MATERIALIZED (
  SELECT conv_id AS doc_id, conv_id || '' AS relative_path, {_lit(r.LANGUAGE)} AS language,
       CASE WHEN max(failed) IS NULL THEN '' ELSE 'Unable to Extract' END
       || coalesce(string_agg(translate(text, chr(10), ' '), '' ORDER BY turn) FILTER (failed IS NULL OR turn > failed), '') AS text
  FROM (SELECT *, max(turn) FILTER (turn % 5 = 3) OVER (PARTITION BY conv_id) AS failed FROM conversations)
  GROUP BY conv_id)""",
        _WORD_CHUNKS,
        _CHUNKS,
    )
    + "SELECT doc_id, chunk_no, relative_path, file_url, chunk, language FROM chunks",
    "request_rows": f"""SELECT conv_id, turn,
       '{{"model":"{r.MODEL}","messages":[{{"role":"user","content":' || to_json(text)::VARCHAR
       || '}}],"options":{{"temperature":1.0}}}}' AS request FROM conversations""",
    "activity_tz": """SELECT event_id, timezone('America/Bogota', timezone('America/Los_Angeles', ts)) AS logged_at FROM events""",
    "activity_ids": "SELECT row_number() OVER (ORDER BY ts, event_id) AS id, event_id FROM events",
    "describe_scores": "SELECT lang, 'n_chars' AS metric, "
    + _DESCRIBED.format("n_chars", "min(n_chars)::DOUBLE", "max(n_chars)::DOUBLE")
    + " FROM documents GROUP BY lang",
    "grouped_sum": """SELECT lang, source, grouping(lang, source)::BIGINT AS level, sum(n_chars)::BIGINT AS sum_n_chars
FROM documents GROUP BY ROLLUP (lang, source)""",
    "preview": _with(_PAIRS) + "SELECT * FROM pairs ORDER BY pair_id LIMIT 5",
    "ngram_counts": _with(_PAIRS, _overlap("u", _unicode))
    + "SELECT pair_id, gram, c::BIGINT AS n_grams FROM u_grams WHERE n = 2 AND c > 0",
    "bleu": _with(_PAIRS, _overlap("m", _mteval), _bleu("m")) + "SELECT pair_id, round(bleu, 4) AS bleu FROM bleus",
    "rouge1": _with(_PAIRS, _overlap("u", _unicode), _rouge(1)) + "SELECT pair_id, round(rouge1, 4) AS rouge1 FROM rouges1",
    "rouge2": _with(_PAIRS, _overlap("u", _unicode), _rouge(2)) + "SELECT pair_id, round(rouge2, 4) AS rouge2 FROM rouges2",
    "rouge_l": _with(_PAIRS, _overlap("u", _unicode), _ROUGE_L) + "SELECT pair_id, round(rouge_l, 4) AS rouge_l FROM rouges_l",
    "score_pairs": _with(*_SCORES, _ALL_SCORES) + _PAIR_SCORES,
    "score_pairs_stemmed": _with(*_STEMMED_SCORES, _ALL_SCORES) + _PAIR_SCORES,
    "stems": _with(
        *stem_steps(f"SELECT DISTINCT unnest({_ASCII.format('text')}) AS token FROM conversations")
    )
    + "SELECT token, stem FROM stems",
    "score_summary": _with(*_SCORES, _ALL_SCORES)
    + " UNION ALL ".join(_describe_score(name) for name in ("bleu", "rouge1", "rouge2", "rouge_l")),
    "score_growth": _with(*_SCORES, _ALL_SCORES)
    + " UNION ALL ".join(_describe_score(name) for name in ("bleu", "rouge1", "rouge2", "rouge_l")),
}
