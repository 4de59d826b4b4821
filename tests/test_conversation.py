import json
import random

import pytest
from pyspark.sql import functions as F

from passageloom import schemas
from passageloom.operators import conversation as conv
from passageloom.operators.index import index_chunks
from passageloom.operators.prompts import answer_prompt, expansion_prompt, request_rows
from passageloom.operators.retrieval import filtered_hits
from passageloom.plans import answers


def talk(spark):
    """Conversation 1 holds most of the messages."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(400)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "a"), (2, 2, "user", "b"), (2, 3, "assistant", "c"), (2, 4, "assistant", "d")]
    rows += [(3, 0, "user", "x"), (3, 1, "system", "s"), (3, 2, "assistant", "y")]
    return spark.createDataFrame(rows, schemas.MESSAGES).repartition(4)


def turns(df, conv_id):
    return sorted(r.turn for r in df.filter(F.col("conv_id") == conv_id).collect())


def test_last_messages(spark, plan):
    df = talk(spark)
    last = conv.history_last_n(df, 3)
    assert (turns(last, 1), turns(last, 2), turns(last, 3)) == ([397, 398, 399], [2, 3, 4], [0, 1, 2])
    without = conv.history_last_n(df, 3, include_current=False)
    assert (turns(without, 1), turns(without, 3)) == ([396, 397, 398], [0, 1])
    assert plan(last).count("WindowGroupLimit") == 2
    for n in (0, 11):
        with pytest.raises(ValueError):
            conv.history_last_n(df, n)


def test_since_clear(spark):
    kept = conv.history_since_clear(talk(spark), F.col("role") == "system")
    assert (turns(kept, 1), turns(kept, 2), turns(kept, 3)) == (list(range(400)), [1, 2, 3, 4], [2])
    assert kept.columns == schemas.MESSAGES.fieldNames()


def test_pairs(spark):
    pairs = {(r.conv_id, r.turn, r.question, r.answer) for r in conv.pair_turns(talk(spark)).collect()}
    assert pairs == {(1, t, f"m{t}", f"m{t + 1}") for t in range(0, 400, 2)} | {(2, 2, "b", "c")}


def gaps(spark):
    """The same conversations with gaps in ``turn``."""
    return talk(spark).withColumn("turn", F.col("turn") * 3 + F.when(F.col("turn") > 1, 5).otherwise(0))


def test_pairs_with_gaps(spark):
    pairs = {(r.conv_id, r.question, r.answer) for r in conv.pair_turns(gaps(spark)).collect()}
    assert pairs == {(1, f"m{t}", f"m{t + 1}") for t in range(0, 400, 2)} | {(2, "b", "c")}


@pytest.mark.parametrize("make", [talk, gaps])
def test_history_of_every_question(spark, make):
    numbered = conv.positions(make(spark)).cache()
    asked = conv.user_questions(numbered)
    assert {(r.conv_id, r.position) for r in asked.collect()} == {(1, t) for t in range(0, 400, 2)} | {(2, 1), (2, 2), (3, 0)}
    assert {r.query_id for r in asked.filter("conv_id = 3").collect()} == {"3/0"}
    last = asked.filter("conv_id > 1 or position = 398")
    text = {r.query_id.split("/")[0] + r.history[-1]: r.history for r in conv.format_history(conv.history_before(last, numbered, 3), "query_id").collect()}
    assert text == {
        "18": "user: m396\nassistant: m397\nuser: m398", "2a": "system: s\nuser: a", "2b": "system: s\nuser: a\nuser: b", "3x": "user: x",
    }
    before = conv.history_before(asked.filter("conv_id = 2 and position = 2"), numbered, 2, include_current=False)
    assert {r.text for r in before.collect()} == {"s", "a"}
    assert {(r.conv_id, r.position) for r in conv.unanswered(asked, numbered).collect()} == {(2, 1), (3, 0)}


def test_fixed_replies_and_notes(spark):
    df = spark.createDataFrame([(" \tHOLA\n",), ("hola!",), (None,)], "question string")
    assert [r.canned for r in conv.route_canned(df, {"hola": "hi"}).collect()] == ["hi", None, None]
    df = spark.createDataFrame([("La SubPartida 1", "a"), ("other", "a"), (None, "a")], "question string, answer string")
    assert [r.answer for r in conv.append_note(df, "subpartida", "!").collect()] == ["a!", "a", "a"]


def test_prompts(spark):
    asked = spark.createDataFrame([(1, "q one"), (2, "q two")], "query_id long, question string")
    context = spark.createDataFrame([(1, "C1")], "query_id long, context string")
    history = spark.createDataFrame([(2, "H2")], "query_id long, history string")
    prompts = {r.query_id: r.prompt for r in answer_prompt(asked, context, history).collect()}
    assert "<context>\nC1\n</context>" in prompts[1] and "<chat_history>\n\n</chat_history>" in prompts[1]
    assert "<context>\n\n</context>" in prompts[2] and "<chat_history>\nH2\n</chat_history>" in prompts[2]
    assert "<question>\nq two\n</question>" in prompts[2]
    plain = {r.query_id: r.prompt for r in answer_prompt(asked, context).collect()}
    assert "H2" not in plain[2]
    expanded = expansion_prompt(asked.join(history, "query_id", "left")).filter("query_id = 1").first().prompt
    assert "<chat_history>\n\n</chat_history>" in expanded and "<question>\nq one\n</question>" in expanded
    request = json.loads(request_rows(asked.withColumn("prompt", F.lit('a "b"\n')), "m", 0.5).first().request)
    assert request == {"model": "m", "messages": [{"role": "user", "content": 'a "b"\n'}], "options": {"temperature": 0.5}}


def test_answers_end_to_end(spark):
    chunks = spark.createDataFrame(
        [(1, 0, "f1", "u1", "f1: mango exports", "es"), (2, 0, "f2", "u2", "f2: coffee exports", "es")], schemas.CHUNKS
    )
    messages = spark.createDataFrame(
        [
            (1, 0, "user", "what's the mango subpartida"),
            (2, 0, "user", " Hola "),
            (3, 0, "user", "coffee"), (3, 1, "assistant", "ok"), (3, 2, "user", "and more coffee $"),
            (4, 0, "user", "unknown"),
        ],
        schemas.MESSAGES,
    )
    numbered = conv.positions(answers.limited(messages))
    questions = {r.query_id: r for r in answers.open_questions(numbered).collect()}
    assert set(questions) == {"1/0", "2/0", "3/2", "4/0"}
    assert questions["2/0"].canned == answers.CANNED["hola"] and questions["1/0"].canned is None
    index = index_chunks(chunks)
    drafts = answers.draft_answers(messages, index, chunks)
    rows = {r.query_id: r for r in drafts.collect()}
    assert set(rows) == set(questions) and rows["2/0"].prompt is None and rows["2/0"].request is None
    assert rows["1/0"].question == "whats the mango subpartida" and "- f1\n" in rows["1/0"].references
    assert "assistant: ok" in rows["3/2"].prompt and "coffee exports" in rows["3/2"].prompt and rows["4/0"].references == ""
    wider = spark.createDataFrame([("4/0", "mango")], "query_id string, text string")
    again = {r.query_id: r for r in answers.draft_answers(messages, index, chunks, expanded=wider).collect()}
    assert again["4/0"].references.endswith("- f1\n") and again["4/0"].question == "unknown"
    filtered = filtered_hits(chunks, conv.user_questions(numbered), {"@eq": {"language": "es"}}, 1)
    live = {r.query_id: r for r in answers.draft_answers(messages, None, chunks, hits=filtered).collect()}
    assert "mango exports" in live["4/0"].prompt
    with pytest.raises(ValueError):
        answers.draft_answers(messages, None, chunks, model="other")
    body = lambda text: json.dumps({"choices": [{"messages": text}]})
    replies = spark.createDataFrame([("1/0", body("a $5 code")), ("3/2", "broken"), ("2/0", body("unused"))], "query_id string, reply string")
    done = {r.query_id: r.answer for r in answers.finish_answers(drafts, replies).collect()}
    assert done == {"1/0": "a \\$5 code" + answers.NOTE, "2/0": answers.CANNED["hola"], "3/2": answers.FAILED, "4/0": answers.MISSING}


def test_history_holds_the_limited_question(spark):
    chunks = spark.createDataFrame([(1, 0, "f", "u", "f: a", "es")], schemas.CHUNKS)
    long = " ".join(f"w{i}" for i in range(150))
    messages = spark.createDataFrame([(1, 0, "user", long)], schemas.MESSAGES)
    row = answers.draft_answers(messages, index_chunks(chunks), chunks).first()
    assert len(row.asked.split()) == 100 and "w99" in row.prompt and "w100" not in row.prompt


def test_pairs_across_ranges_of_turns(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"{c}.{t}") for c in range(5) for t in sorted(rng.sample(range(-40, 400), 90))]
    want = set()
    for (c, t, role, text), (c2, _, role2, text2) in zip(rows, rows[1:]):
        if c == c2 and (role, role2) == ("user", "assistant"):
            want.add((c, t, text, text2))
    monkeypatch.setattr(conv, "TURN_RANGE", 7)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert {tuple(r) for r in conv.pair_turns(frame).collect()} == want
