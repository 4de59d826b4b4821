import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from passageloom.llm import pieces

RAW = open(pieces.MODEL, "rb").read()


@pytest.fixture(scope="module")
def model():
    return pieces.Model(RAW)


def samples():
    rng = random.Random(4)
    letters = "ab é²½1_-.,(  \n\t漢é'\"xyz the　0٣Ⅷ^|&&&!!☃"
    yield from ("", " ", "   a  b ", "a" * 3000, "ab" * 2000 + " x", "\n\n a", "<s> x </s>", "é\x00")
    for _ in range(3000):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))


def test_ids_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in samples():
        assert list(model.encode(text)) == library.encode(text), text


def test_round_trip(model):
    for text in [*samples(), "▁", "a▁▁ b", " ▁x"]:
        assert model.decode(model.encode(text)) == text


def test_commits_early_and_alike(model, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice(["the", "ing", "on", "er", "qu", "z"]) for _ in range(2000))
    whole = list(model.search(text))
    monkeypatch.setattr(pieces, "_COMMIT_EVERY", 64)
    assert list(pieces.Model(RAW).search(text)) == whole
    stream = pieces.Model(RAW).search(text)
    next(stream)  # comes before the end of the text is reached


def test_unigram_model_finds_the_best_path():
    proto = pb.ModelProto()
    proto.ParseFromString(RAW)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for rank, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = -(rank**0.5)
    model = pieces.Model(proto.SerializeToString())
    rng = random.Random(6)
    for _ in range(200):
        text = "▁" + "".join(rng.choice(["the", "in", "er", "q", "ou"]) for _ in range(rng.randint(1, 5)))
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - model.longest), end):
                if text[begin:end] in model.scores:
                    best[end] = max(best[end], best[begin] + model.scores[text[begin:end]])
        found = list(model.search(text))
        assert "".join(found) == text
        assert sum(model.scores[p] for p in found) == pytest.approx(best[-1])


def test_tables(docs, rows, nothing):
    out = pieces.encode(docs).collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in out)
    decoded = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in decoded), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert pieces.encode(nothing).collect() == []


def test_ids_that_are_no_text(spark, model):
    for text in [*samples(), "▁", "a▁▁ b", " ▁x"]:
        assert model.decode_any(model.encode(text)) == text
    n, word = len(model.pieces), list(model.encode("word"))
    lead = next(i for i, value in model.byte_of.items() if value == 0xE2)
    control = [i for i, p in enumerate(model.pieces) if p in ("<s>", "</s>", "<unk>")]
    assert control and model.decode_any([*control, *word, *control]) == "word"
    assert model.decode_any([*word, lead]) == "word�" and model.decode_any([*word, n, -1, None]) == "word���"
    rows = [(1, [*word, None]), (1, [*word, None]), (None, [n + 5]), (3, None), (4, []), (5, [lead, lead])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = sorted(((r.doc_id, r.text) for r in pieces.decode(frame).collect()), key=str)
    assert got == sorted([(1, "word�"), (1, "word�"), (None, "�"), (3, ""), (4, ""), (5, "��")], key=str)
    assert pieces.decode(frame.limit(0)).collect() == []


def test_short_texts_are_searched_whole(model, monkeypatch):
    """The same pieces as by the streaming search, and no search of nothing between characters that no piece covers."""
    texts = [text.replace(" ", "▁") for text in samples() if text][:1500]
    unknown = next(chr(c) for c in range(0x4E00, 0x9FFF) if chr(c) not in model.chars)
    searched = []
    paths = pieces.Model._paths
    monkeypatch.setattr(pieces.Model, "_paths", lambda self, text: searched.append(text) or paths(self, text))
    assert list(model.search(unknown * 40 + "the")) == [unknown] * 40 + ["the"]
    assert searched == ["the"]
    for text in texts:
        known = "".join(c for c in text if c in model.chars)
        assert list(model.search(known)) == list(model._streamed(known))


def test_merges_of_long_texts_take_the_best_and_leftmost_first(model):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aeinrst▁th") for _ in range(rng.randint(1, 40)))
        parts = list(text)
        while True:
            joins = [(model.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.scores]
            if not joins:
                break
            i = -max(joins)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert model.merge(text) == parts
