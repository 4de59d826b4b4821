"""Named queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageloom import schemas
from passageloom.functions import text as tx
from passageloom.functions.filters import compile_filter
from passageloom.operators import conversation as conv
from passageloom.operators import prompts, retrieval, scoring, stats
from passageloom.operators.activity import assign_ids
from passageloom.operators.chunking import chunk_chars, chunk_words
from passageloom.operators.corpus import project
from passageloom.operators.index import KEY, index_chunks
from passageloom.operators.pages import assemble_pages
from passageloom.plans import answers, evaluation
from passageloom.plans.corpus import chunk_table, paged_chunk_table, staged_files
from passageloom.session import materialize, scratch_path
from passageloom.sources import files
from passageloom.sources.score_store import ScoreStore
from passageloom.streaming.activity_stream import activity_stream, read_log
from passageloom.streaming import live_drafts as live
from passageloom.streaming.index_refresh import IndexStore, refresh_index

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Parameters that the queries and their SQL share.
LANGUAGE = "es"
KEYWORD = "the"
NOTE = " (see the note)"
REPLIES = ["fixed reply one", "fixed reply two", "fixed reply three"]
FALLBACK = "nothing found"
ROUTED = {"@and": [{"@eq": {"language": LANGUAGE}}]}
MODEL = answers.MODELS[0]


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, d) -> DataFrame:
    return spark.read.schema(schemas.DOCUMENTS).parquet(f"{d}/documents.parquet")


def _messages(spark, d) -> DataFrame:
    return spark.read.schema(schemas.MESSAGES).parquet(f"{d}/conversations.parquet")


def _stream(spark: SparkSession, d: str, name: str, schema: T.StructType) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder of them: a stream takes a lone file by a pattern only."""
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def _chunks(spark, d) -> DataFrame:
    return chunk_table(staged_files(_documents(spark, d)))


def _stored_chunks(spark, d) -> DataFrame:
    path = scratch_path(spark, "chunks")
    files.write_chunks(_chunks(spark, d), path=path)
    return files.read_chunks(spark, path=path)


def _numbered(spark, d) -> DataFrame:
    return materialize(conv.positions(_messages(spark, d)), "messages")


def _questions(spark, d) -> DataFrame:
    """Every user message."""
    return conv.user_questions(_numbered(spark, d))


def _hits(spark, d, filter: dict | None = None) -> DataFrame:
    chunks = _stored_chunks(spark, d)
    found = retrieval.search_topk(index_chunks(chunks), _questions(spark, d), answers.HITS, filter)
    return retrieval.hit_chunks(found, chunks)


def _timed(messages: DataFrame) -> DataFrame:
    """Messages with a time stamp: one minute per conversation, one second per turn."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("decimal(18,6)"))
    return messages.withColumn("ts", start + step)


def _by_parity(pairs: DataFrame) -> list[DataFrame]:
    """Two appends to a log, where the ids of the second go on from the first's; every row is in one of them."""
    pairs = materialize(pairs, "pairs")
    remainder = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(2))
    return [pairs.filter(remainder == value) for value in (0, 1)]


# Sources and sinks


@query
def src_listing(spark, d):
    path = scratch_path(spark, "staged")
    # One file per source, so the listing has a row for each.
    sources = _documents(spark, d).select("source", F.lit("").alias("value")).distinct()
    sources.repartition("source").write.partitionBy("source").text(path)
    listed = files.list_sources(spark, path, "*.txt")
    return listed.select(F.regexp_extract("relative_path", "^source=([^/]+)/", 1).alias("source"))


@query
def src_extension(spark, d):
    return files.filter_extension(_read(spark, d, "pages"), ".html", "url").select("page_id", "url")


@query
def src_latest(spark, d):
    return files.latest_per_path(_read(spark, d, "events"), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value"
    )


@query
def source_changes(spark, d):
    """Two listings of the users' newest events: as of mid-month, and of the days since the 8th."""
    events = _read(spark, d, "events")
    before = files.latest_per_path(events.filter("ts < timestamp_ntz'2024-01-16'"), "user_id", ["ts", "event_id"])
    after = files.latest_per_path(events.filter("ts >= timestamp_ntz'2024-01-08'"), "user_id", ["ts", "event_id"])
    return files.source_changes(before, after, "user_id", ("ts", "event_id"))


@query
def scan_chunks(spark, d):
    return _stored_chunks(spark, d).select(*KEY, "relative_path", "language", F.length("chunk").alias("chunk_chars"))


@query
def eval_pairs(spark, d):
    path = scratch_path(spark, "sheet")
    sheet = evaluation.message_pairs(_messages(spark, d)).select(
        F.col("candidate").alias("model_answer"),
        F.length("candidate").alias("remark"),
        F.col("pair_id").alias("row_id"),
        F.col("reference").alias("human_answer"),
    )
    sheet.write.option("header", True).option("escape", '"').csv(path)
    return files.read_pairs(spark, path, "human_answer", "model_answer", "row_id", "csv")


@query
def chunk_table_rows(spark, d):
    return _stored_chunks(spark, d).select(*schemas.CHUNKS.fieldNames())


_QUERIES["chunk_table"] = _QUERIES.pop("chunk_table_rows")


@query
def activity_log(spark, d):
    path = scratch_path(spark, "activity")
    messages = _timed(_messages(spark, d))
    pairs = conv.pair_turns(messages, keep=("ts",))
    for part in _by_parity(pairs):
        files.append_activity(part, path)
    return files.read_activity(spark, path)


# Projections and filters


@query
def retrieve_filtered(spark, d):
    return retrieval.retrieve_filtered(
        _chunks(spark, d), ["chunk", "file_url", "relative_path"], ROUTED, answers.HITS
    )


@query
def filter_dsl(spark, d):
    expr = {"@and": [{"@eq": {"lang": LANGUAGE}}, {"@eq": {"source": "src1"}}]}
    return project(_documents(spark, d).filter(compile_filter(expr)), ["doc_id", "lang", "source", "n_chars"])


# Text preparation


@query
def clean_text(spark, d):
    return _documents(spark, d).select("doc_id", tx.clean_page_text(F.col("text")).alias("cleaned"))


@query
def assembled_pages(spark, d):
    pages = _messages(spark, d).select(
        F.col("conv_id").alias("relative_path"),
        F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 5 != 3, F.col("text")).alias("text"),
    )
    return assemble_pages(pages)


_QUERIES["assemble_pages"] = _QUERIES.pop("assembled_pages")


def _chunk_query(name: str, chunker) -> None:
    def run(spark, d):
        cleaned = _documents(spark, d).select("doc_id", tx.clean_page_text(F.col("text")).alias("text"))
        return chunker(cleaned)

    _QUERIES[name] = run


_chunk_query("chunk_words", chunk_words)
_chunk_query("chunk_chars", chunk_chars)


# Retrieval


@query
def search_topk(spark, d):
    index = index_chunks(_stored_chunks(spark, d))
    return retrieval.search_topk(index, _questions(spark, d), answers.HITS)


@query
def search_filtered(spark, d):
    index = index_chunks(_stored_chunks(spark, d))
    queries = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.search_topk(index, queries, answers.HITS, ROUTED)


@query
def search_pruned(spark, d):
    index = index_chunks(_stored_chunks(spark, d))
    queries = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.search_topk(index, queries, answers.HITS)


@query
def context_block(spark, d):
    return retrieval.context_block(_hits(spark, d))


@query
def references(spark, d):
    return retrieval.references(_hits(spark, d))


@query
def filtered_context(spark, d):
    hits = retrieval.filtered_hits(_chunks(spark, d), _questions(spark, d), ROUTED, answers.HITS)
    return retrieval.context_and_references(hits).select("query_id", "context", "references")


@query
def index_merged(spark, d):
    """Documents in four batches of languages, each with older texts of the next one's; read after a merge."""
    store = IndexStore(scratch_path(spark, "store"))
    documents = materialize(_documents(spark, d), "documents")
    older = documents.withColumns({"text": F.upper(F.reverse("text")), "n_chars": F.lit(-1).cast("long")})
    group = F.when(F.col("lang").isin("en", "de", "fr"), F.col("lang")).otherwise(F.lit("others"))
    for number, (rows, ahead) in enumerate([("en", "de"), ("de", "fr"), ("fr", "others"), ("others", "others")]):
        batch = documents.filter(group == rows).unionByName(older.filter(group == ahead))
        store.add(batch, number, ["n_chars"])
    store.merge(spark)
    index = store.index(spark)
    counts = index.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("chunks"))
    return index.terms.join(counts, "term").select("term", "df", "chunks", "tf")


@query
def index_refresh(spark, d):
    path = scratch_path(spark, "store")
    stream = _stream(spark, d, "documents", schemas.DOCUMENTS)
    refresh_index(stream, path, f"{path}-checkpoint", ["n_chars", "text"], lag=None).awaitTermination()
    index = IndexStore(path).index(spark)
    counts = index.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("chunks"))
    return index.terms.join(counts, "term").select("term", "df", "chunks", "tf")


# Conversations


@query
def history_last_n(spark, d):
    return conv.history_last_n(_messages(spark, d), answers.HISTORY)


@query
def history_without_current(spark, d):
    return conv.history_last_n(_messages(spark, d), answers.HISTORY, include_current=False)


@query
def history_since_clear(spark, d):
    return conv.history_since_clear(_messages(spark, d), F.col("role") == "system")


@query
def history_text(spark, d):
    return conv.format_history(conv.history_last_n(_messages(spark, d), answers.HISTORY))


@query
def qa_pairs(spark, d):
    return conv.pair_turns(_messages(spark, d))


@query
def limit_words(spark, d):
    return _messages(spark, d).select("conv_id", "turn", tx.limit_words(F.col("text"), 10).alias("limited"))


@query
def route_canned(spark, d):
    messages = _messages(spark, d)
    # The phrases are the shortest messages there are.
    phrase = F.lower(tx.strip_space(F.col("text")))
    shortest = messages.select(phrase.alias("phrase")).distinct().orderBy(F.length("phrase"), "phrase").limit(len(REPLIES))
    replies = dict(zip([row.phrase for row in shortest.collect()], REPLIES))
    asked = messages.select("conv_id", "turn", F.concat(F.lit(" \t"), F.col("text"), F.lit("\n")).alias("question"))
    return conv.route_canned(asked, replies).select("conv_id", "turn", "canned")


@query
def append_note(spark, d):
    return conv.append_note(conv.pair_turns(_messages(spark, d)), KEYWORD, NOTE).select("conv_id", "turn", "answer")


@query
def escape_text(spark, d):
    marked = F.concat(F.lit("it's $5 'now': "), F.col("text"))
    return _messages(spark, d).select(
        "conv_id", "turn", tx.strip_quotes(marked).alias("unquoted"), tx.escape_dollar(marked).alias("escaped")
    )


@query
def extract_json(spark, d):
    return _read(spark, d, "events").select("event_id", tx.extract_answer(F.col("props"), "$.k").alias("answer"))


@query
def fallback_answer(spark, d):
    found = F.when(F.col("event_type") == "error", F.lit("")).otherwise(
        F.when(F.col("event_type") != "view", tx.extract_answer(F.col("props"), "$.k"))
    )
    return _read(spark, d, "events").select("event_id", tx.fallback_answer(found, FALLBACK).alias("answer"))


@query
def expansion_prompt(spark, d):
    numbered = _numbered(spark, d)
    questions = conv.user_questions(numbered)
    history = conv.format_history(conv.history_before(questions, numbered, answers.HISTORY), "query_id")
    rows = questions.select("query_id", F.col("text").alias("question")).join(history, "query_id", "left")
    return prompts.expansion_prompt(rows).select("query_id", "prompt")


@query
def answer_prompt(spark, d):
    numbered = _numbered(spark, d)
    questions = conv.user_questions(numbered)
    history = conv.format_history(conv.history_before(questions, numbered, answers.HISTORY), "query_id")
    asked = questions.select("query_id", F.col("text").alias("question"))
    return prompts.answer_prompt(asked, retrieval.context_block(_hits(spark, d)), history)


# From open questions to the log


@query
def open_questions(spark, d):
    numbered = conv.positions(answers.limited(_messages(spark, d)))
    return answers.open_questions(numbered).select("query_id", "conv_id", "turn", "asked", "question", "canned")


def _drafts(spark, d) -> DataFrame:
    chunks = _stored_chunks(spark, d)
    return materialize(answers.draft_answers(_messages(spark, d), index_chunks(chunks), chunks), "drafts")


@query
def draft_answers(spark, d):
    return _drafts(spark, d)


@query
def live_drafts(spark, d):
    """Every user message drafted as it arrives, in an index that was merged before."""
    path = scratch_path(spark, "live")
    store = IndexStore(f"{path}-store")
    store.add(_documents(spark, d), 0, ["n_chars"])
    store.merge(spark)
    stream = _stream(spark, d, "conversations", schemas.MESSAGES)
    live.live_drafts(stream, store, f"{path}-drafts", f"{path}-checkpoint").awaitTermination()
    return live.read_drafts(spark, f"{path}-drafts").drop("batch")


def _finished(spark, d) -> DataFrame:
    """Replies by conversation: the first assistant message, broken text, none, and an empty answer, in turn."""
    drafts = _drafts(spark, d)
    said = (
        _messages(spark, d).filter(F.col("role") == "assistant").groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("said"))
    )
    kind = F.col("conv_id") % 4
    body = F.when(kind == 3, F.lit("")).otherwise(F.coalesce("said", F.lit("no message")))
    good = F.to_json(F.struct(F.array(F.struct(body.alias("messages"))).alias("choices")))
    replies = drafts.join(said, "conv_id", "left").filter(kind != 2).select(
        "query_id", F.when(kind == 1, F.lit("broken")).otherwise(good).alias("reply")
    )
    return answers.finish_answers(drafts, replies)


@query
def finish_answers(spark, d):
    return _finished(spark, d)


@query
def answer_log(spark, d):
    path = scratch_path(spark, "answers")
    for part in _by_parity(_timed(_finished(spark, d))):
        files.append_activity(part, path)
    return files.read_activity(spark, path)


@query
def paged_chunks(spark, d):
    pages = _messages(spark, d).select(
        F.col("conv_id").cast("string").alias("relative_path"),
        F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 5 != 3, F.col("text")).alias("text"),
    )
    named = pages.select(
        F.col("relative_path").cast("long").alias("doc_id"), "relative_path", F.lit(LANGUAGE).alias("language")
    ).distinct()
    return paged_chunk_table(named, pages)


@query
def request_rows(spark, d):
    rows = _messages(spark, d).select("conv_id", "turn", F.col("text").alias("prompt"))
    return prompts.request_rows(rows, MODEL).select("conv_id", "turn", "request")


# Activity log


@query
def activity_tz(spark, d):
    return _read(spark, d, "events").select("event_id", tx.convert_tz(F.col("ts")).alias("logged_at"))


@query
def activity_ids(spark, d):
    return assign_ids(_read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("id", "event_id")


@query
def activity_messages(spark, d):
    path = scratch_path(spark, "log")
    stream = _stream(spark, d, "conversations", schemas.MESSAGES)
    activity_stream(_timed(stream), path, f"{path}-checkpoint", "1 hour").awaitTermination()
    return read_log(spark, path).select(*schemas.ACTIVITY.fieldNames())


_QUERIES["activity_stream"] = _QUERIES.pop("activity_messages")


# Statistics


@query
def describe_scores(spark, d):
    rows = stats.describe_scores(_documents(spark, d), ["n_chars"], ["lang"])
    return _rounded(rows, "mean", "std", "q25", "q50", "q75")


@query
def grouped_sum(spark, d):
    return stats.grouped_sum(_documents(spark, d), ["lang", "source"], ["n_chars"]).select(
        "lang", "source", F.col("level").cast("long").alias("level"), "sum_n_chars"
    )


@query
def preview(spark, d):
    return stats.preview(evaluation.message_pairs(_messages(spark, d)), ["pair_id"])


# Evaluation


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in cols})


def _pairs_with_conversation(spark, d) -> DataFrame:
    return _pairs(spark, d).withColumn("conv_id", F.substring_index("pair_id", "/", 1).cast("long"))


def _pairs(spark, d) -> DataFrame:
    return evaluation.message_pairs(_messages(spark, d))


@query
def ngram_counts(spark, d):
    texts = _pairs(spark, d).select("pair_id", F.col("candidate").alias("text"))
    return scoring.ngram_counts(texts, 2)


@query
def bleu(spark, d):
    return _rounded(scoring.score_bleu(_pairs(spark, d)), "bleu")


@query
def rouge1(spark, d):
    return _rounded(scoring.score_rouge_n(_pairs(spark, d), 1, "unicode", stemmed=False), "rouge1")


@query
def rouge2(spark, d):
    return _rounded(scoring.score_rouge_n(_pairs(spark, d), 2, "unicode", stemmed=False), "rouge2")


@query
def rouge_l(spark, d):
    return _rounded(scoring.score_rouge_l(_pairs(spark, d), "unicode", stemmed=False), "rouge_l")


@query
def stems(spark, d):
    words = _messages(spark, d).select(F.explode(tx.tokens(F.col("text"), "ascii")).alias("token"))
    return scoring.stem_vocabulary(words)


@query
def score_pairs(spark, d):
    scored = scoring.score_pairs(_pairs(spark, d), "unicode", stemmed=False)
    return _rounded(scored, *evaluation.SCORES)


@query
def score_pairs_stemmed(spark, d):
    return _rounded(scoring.score_pairs(_pairs(spark, d)), *evaluation.SCORES)


@query
def score_summary(spark, d):
    rows = evaluation.evaluate(_pairs(spark, d), tokenizer="unicode", stemmed=False)
    return _rounded(rows, "mean", "std", "min", "q25", "q50", "q75", "max")


@query
def score_growth(spark, d):
    """The score summary from the value counts of two appends."""
    store = ScoreStore(scratch_path(spark, "scores"), tuple(evaluation.SCORES))
    for number, part in enumerate(_by_parity(_pairs_with_conversation(spark, d))):
        store.append(scoring.score_pairs(part, "unicode", stemmed=False), number)
    return _rounded(store.describe(spark), "mean", "std", "min", "q25", "q50", "q75", "max")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Prompt, references and model request, or the fixed reply, of every open question."""
    chunks = materialize(_chunks(spark, d), "chunks")
    return answers.draft_answers(_messages(spark, d), index_chunks(chunks), chunks)
