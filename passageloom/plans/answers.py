"""Questions to prompts, and model replies to log rows, for all conversations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.functions.text import answer_or_error, escape_dollar, limit_words, strip_quotes
from passageloom.operators.conversation import (
    append_note,
    format_history,
    history_before,
    positions,
    route_canned,
    unanswered,
    user_questions,
)
from passageloom.operators.index import Index
from passageloom.operators.prompts import answer_prompt, request_rows
from passageloom.operators.retrieval import context_and_references, hit_chunks, search_topk
from passageloom.session import materialize

# Defaults and allowed models of the question form.
QUESTION_WORDS = 100
ANSWER_WORDS = 500
HITS = 5
HISTORY = 5
TEMPERATURE = 1.0
MODELS = ["reka-core", "llama3.2-3b", "llama3.1-8b", "mistral-7b"]

# The phrases with a reply of their own, and the word that calls for the note.
CANNED = {
    "hola": "Hello! Ask me anything about the documents in this collection.",
    "gracias": "You are welcome. I am here whenever you have another question.",
}
NOTE_KEYWORD = "subpartida"
NOTE = "\n\n**Note:** Please check tariff codes with the customs authority of the country concerned."
MISSING = "Answer not available."
FAILED = "The answer could not be generated."


def _check_model(model: str) -> None:
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")


def limited(messages: DataFrame, words: int = QUESTION_WORDS) -> DataFrame:
    """Messages as the conversation keeps them: user texts are cut to ``words`` before they are stored."""
    text = F.when(F.col("role") == "user", limit_words(F.col("text"), words)).otherwise(F.col("text"))
    return messages.withColumn("text", text)


def open_questions(numbered: DataFrame) -> DataFrame:
    """``(query_id, conv_id, turn, position, asked, question, canned)`` of the user messages without an answer.

    ``numbered`` has limited texts and positions. ``question`` has no quotes;
    ``canned`` is the fixed reply of a known phrase, else null.
    """
    return routed(unanswered(user_questions(numbered), numbered).withColumnRenamed("text", "asked"))


def routed(asked: DataFrame) -> DataFrame:
    """``asked`` with ``question``, its text without quotes, and ``canned``, the fixed reply of a known phrase or null."""
    return route_canned(asked.withColumn("question", strip_quotes(F.col("asked"))), CANNED, "asked")


def draft_answers(
    messages: DataFrame,
    index: Index,
    chunks: DataFrame,
    k: int = HITS,
    history: int | None = HISTORY,
    filter: dict | None = None,
    model: str = MODELS[0],
    temperature: float = TEMPERATURE,
    expanded: DataFrame | None = None,
    hits: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, conv_id, turn, asked, question, canned, prompt, references, request)`` of every open question.

    Questions with a fixed reply have no prompt and no request. ``expanded``
    (``query_id, text``) replaces the search texts of its questions, for example by
    replies to ``expansion_prompt``; ``hits`` (``query_id, rank, chunk,
    relative_path``) replaces the ranked search, for example by filtered rows.
    """
    _check_model(model)
    numbered = materialize(positions(limited(messages)), "messages")
    questions = materialize(open_questions(numbered), "questions")
    searched = questions.filter(F.col("canned").isNull())
    if hits is None:
        hits = search_hits(searched, index, chunks, k, filter, expanded)
    histories = None
    if history is not None:
        histories = format_history(history_before(searched, numbered, history), "query_id")
    return drafts_of(questions, hits, histories, model, temperature)


def search_hits(
    searched: DataFrame, index: Index, chunks: DataFrame, k: int = HITS, filter: dict | None = None, expanded: DataFrame | None = None
) -> DataFrame:
    """The chunks that answer the prompts of ``searched`` (``query_id, question``); ``expanded`` as in ``draft_answers``."""
    texts = searched.select("query_id", F.col("question").alias("text"))
    if expanded is not None:
        wider = expanded.select("query_id", F.col("text").alias("_wider"))
        texts = texts.join(wider, "query_id", "left").select("query_id", F.coalesce("_wider", "text").alias("text"))
    return hit_chunks(search_topk(index, texts, k, filter), chunks)


def drafts_of(
    questions: DataFrame, hits: DataFrame, histories: DataFrame | None, model: str = MODELS[0], temperature: float = TEMPERATURE
) -> DataFrame:
    """The rows of ``draft_answers`` for ``questions``, their ``hits`` and, if wanted, ``histories`` (``query_id, history``)."""
    _check_model(model)
    searched = questions.filter(F.col("canned").isNull())
    found = context_and_references(hits)
    carried = ["conv_id", "turn", "asked", "canned", "references"]
    prompts = request_rows(answer_prompt(searched, found, histories, carried), model, temperature)
    prompts = prompts.withColumn("references", F.coalesce("references", F.lit("")))
    fixed = questions.filter(F.col("canned").isNotNull()).select(
        *(F.col(c) if c in questions.columns else F.lit("" if c == "references" else None).cast("string").alias(c) for c in prompts.columns)
    )
    columns = ["query_id", "conv_id", "turn", "asked", "question", "canned", "prompt", "references", "request"]
    return prompts.unionByName(fixed).select(*columns)


def finish_answers(drafts: DataFrame, replies: DataFrame, words: int = ANSWER_WORDS) -> DataFrame:
    """``(query_id, conv_id, turn, question, answer, references)`` of drafts and ``(query_id, reply)`` model output.

    A fixed reply is the answer as it stands; model replies are limited, escaped and get their note.
    """
    answer = escape_dollar(limit_words(answer_or_error(F.col("reply"), MISSING, FAILED), words))
    answered = append_note(drafts.join(replies, "query_id", "left").withColumn("answer", answer), NOTE_KEYWORD, NOTE, "asked")
    return answered.select(
        "query_id", "conv_id", "turn", "question", F.coalesce("canned", "answer").alias("answer"), "references"
    )
