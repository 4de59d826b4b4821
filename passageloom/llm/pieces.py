"""SentencePiece encoding and decoding by a streaming Viterbi search.

Positions of a text are visited once, from left to right. A position keeps one
backpointer to the piece that ends there; only positions within the longest
piece can still be extended, so when the backpointer paths of these meet in one
boundary, everything before it is final and is committed.

For a unigram model a path's worth is the sum of its scores. For a merge (BPE)
model sums of scores don't give the model's segmentation; there a step is
allowed only if the merges of the two neighbouring pieces together give these
two pieces again, which leaves one path to every position.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageloom.llm.common import batched, rows_of, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Stands for a literal mark in a text; no UTF-8 text holds a lone surrogate.
_LITERAL = "\ud800"
_LETTER = re.compile(r"[^\W\d_\u00b2\u00b3\u00b9]")  # without the raised digits
_UNIGRAM, _BPE = 1, 2
_NORMAL, _USER, _BYTE = 1, 4, 6
_UNKNOWN_PENALTY = 10.0
_COMMIT_EVERY = 512
# Entries of a memo. A full one of units becomes the older one, so that frequent units are kept.
_MEMO = 1 << 18


class Model:
    """Pieces and scores of a model file with an identity normaliser and byte fallback."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        self.kind = proto.trainer_spec.model_type
        rules = proto.normalizer_spec
        if rules.name != "identity" or rules.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with an identity normaliser and byte fallback are supported")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix = rules.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type in (_NORMAL, _USER):
                self.ids[p.piece], self.scores[p.piece] = i, p.score
            elif p.type == _BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value], self.byte_of[i] = i, value
        self.longest = max(map(len, self.ids))
        self.chars = {c for p in self.ids for c in p}
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p) + 1)} | self.chars
        # Whether a prefix of a piece is one itself.
        self.wholes = {p: p in self.scores for p in self.prefixes}
        self.unknown = min(self.scores.values()) - _UNKNOWN_PENALTY
        # No piece goes on past the start of a run of spaces, so every path has a boundary there.
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._fits: dict[str, dict[str, bool]] = {}
        self._known = 0
        self._memo: dict[str, array] = {}
        self._older: dict[str, array] = {}
        blank = "".join(c for c in "\n\t" if c not in self.chars)
        alone = f"|[{blank}]" if blank else ""
        # Where no piece has a letter beside another mark, paths have a boundary between the two as well.
        if any(len({bool(_LETTER.match(c)) for c in p.lstrip(SPACE)}) > 1 for p in self.ids):
            self._units = re.compile(f" *[^ {blank}]+{alone}| +")
        else:
            self._units = re.compile(rf" *{_LETTER.pattern}+| *(?:[^\w {blank}]|[\d_\u00b2\u00b3\u00b9])+{alone}| +")

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by the model's merges: best score first, leftmost of equals."""
        score, none = self.scores.get, float("-inf")
        parts = list(text)
        joins = [score(a + b, none) for a, b in pairwise(parts)]
        while joins and (best := max(joins)) > none:
            i = joins.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i < len(joins):
                joins[i] = score(parts[i] + parts[i + 1], none)
            if i:
                joins[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def neighbours(self, left: str) -> dict[str, bool]:
        """What is known of the pieces after ``left`` (empty at the start)."""
        found = self._fits.get(left)
        if found is None:
            if self._known > _MEMO:
                self._fits.clear()
                self._known = 0
            found = self._fits[left] = {}
        return found

    def fits(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """Whether the merges of both together leave both as they are."""
        self._known += 1
        found = known[right] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def search(self, text: str) -> Iterator[str]:
        """Pieces of ``text``, each as soon as every surviving path goes through it.

        A character that is in no piece comes out alone.
        """
        if self.chars.issuperset(text):
            yield from self._paths(text)
            return
        begin = 0
        for stop, c in enumerate(text):
            if c not in self.chars:
                # No piece covers it, so the paths meet before and after it; merges don't cross it either.
                if begin < stop:
                    yield from self._paths(text[begin:stop])
                yield c
                begin = stop + 1
        if begin < len(text):
            yield from self._paths(text[begin:])

    def _paths(self, text: str) -> Iterable[str]:
        if self.kind == _BPE and len(text) <= _COMMIT_EVERY:
            return self._path(text)
        return self._streamed(text)

    def _path(self, text: str) -> list[str]:
        """The pieces of a text too short to be committed in parts, by a merge model's steps: one path leads to a position."""
        n, longest, wholes, neighbours = len(text), self.longest, self.wholes, self._fits.get
        back = [-1] * (n + 1)  # position -> start of the piece that ends there
        back[0] = 0
        for begin in range(n):
            start = back[begin]
            if start < 0:
                continue
            left = text[start:begin]
            known = neighbours(left)
            if known is None:
                known = self.neighbours(left)
            for end in range(begin + 1, min(n, begin + longest) + 1):
                piece = text[begin:end]
                whole = wholes.get(piece)
                if whole is None:
                    break
                if back[end] < 0 and (whole or end == begin + 1):
                    ok = known.get(piece)
                    if self.fits(left, piece, known) if ok is None else ok:
                        back[end] = begin
        return self._trace(text, back, 0, n)

    def _streamed(self, text: str) -> Iterator[str]:
        n, longest, scores, prefixes = len(text), self.longest, self.scores, self.prefixes
        bpe = self.kind == _BPE
        # Position -> start of the piece that ends there, and for unigram models the sum of scores; uncommitted ones only.
        back: dict[int, int] = {0: -1}
        best: dict[int, float] = {0: 0.0}
        done, left = 0, ""
        for begin in range(n):
            start = back.get(begin)
            if start is None:
                continue
            if begin > done:
                left = text[start:begin]
            if bpe:
                known = self.neighbours(left)
            else:
                so_far = best[begin]
            for end in range(begin + 1, min(n, begin + longest) + 1):
                piece = text[begin:end]
                if piece not in prefixes:
                    break
                if bpe:
                    if end not in back and (piece in scores or end == begin + 1):
                        ok = known.get(piece)
                        if self.fits(left, piece, known) if ok is None else ok:
                            back[end] = begin
                else:
                    score = scores.get(piece, self.unknown if end == begin + 1 else None)
                    if score is not None and (end not in back or so_far + score > best[end]):
                        back[end], best[end] = begin, so_far + score
            if begin - done >= _COMMIT_EVERY and begin % 64 == 0:
                until = self._meeting(back, begin)
                if until > done:
                    out = self._trace(text, back, done, until)
                    yield from out
                    # Starts before the boundary belong to paths that are gone.
                    back = {p: b for p, b in back.items() if p > until and b >= until} | {until: until - len(out[-1])}
                    best = {p: best[p] for p in back if p in best}
                    done, left = until, out[-1]
                    if begin > until:
                        left = text[back[begin] : begin] if begin in back else left
        yield from self._trace(text, back, done, n)

    @staticmethod
    def _meeting(back: dict[int, int], at: int) -> int:
        """The boundary in which the paths to ``at`` and to every later position meet."""
        alive = {p for p in back if p >= at}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last])
        return alive.pop()

    @staticmethod
    def _trace(text: str, back: dict[int, int] | list[int], done: int, end: int) -> list[str]:
        out = []
        while end > done:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def unit(self, text: str) -> array:
        """Ids of a stretch that starts and ends at boundaries of every path."""
        ids = self._older.get(text)
        if ids is not None:
            self._memo[text] = ids
            return ids
        # A space and the literal mark for it differ: the mark itself is written as bytes, so decoding is exact.
        marked = text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        ids = array("i")
        for piece in self.search(marked):
            number = self.ids.get(piece)
            if number is not None:
                ids.append(number)
            else:
                raw = SPACE if piece == _LITERAL else piece
                ids.extend(self.bytes[b] for b in raw.encode("utf-8", "surrogatepass"))
        if len(text) <= 64:
            if len(self._memo) > _MEMO:
                self._older = dict(self._memo)
                self._memo.clear()
            self._memo[text] = ids
        return ids

    def encode(self, text: str) -> array:
        if not text:
            return array("i")
        marked = " " + text if self.prefix else text
        if not self.cuts_at_space:
            return self.unit(marked)
        ids, known, unit = array("i"), self._memo.get, self.unit
        for part in self._units.findall(marked):
            ids.extend(known(part) or unit(part))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        out, pending, pieces, byte_of = [], bytearray(), self.pieces, self.byte_of
        if not isinstance(ids, Iterator) and byte_of.keys().isdisjoint(ids):
            out, ids = [pieces[i] for i in ids], ()
        for i in ids:
            value = byte_of.get(i)
            if value is not None:
                pending.append(value)
                continue
            if pending:
                out.append(pending.decode("utf-8", "surrogatepass").replace(SPACE, _LITERAL))
                pending = bytearray()
            out.append(pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "surrogatepass").replace(SPACE, _LITERAL))
        text = "".join(out).replace(SPACE, " ").replace(_LITERAL, SPACE)
        return text[1:] if self.prefix and text[:1] == " " else text


    def decode_any(self, ids: Iterator[int | None]) -> str:
        """``decode`` for ids that needn't be a text's: U+FFFD for bytes that are no UTF-8 and for ids that are
        null or beyond the model, nothing for ids that are no piece of a text (control, unknown)."""
        out, pending = [], bytearray()
        own = self.ids

        def bytes_so_far() -> None:
            nonlocal pending
            try:
                text = pending.decode("utf-8", "surrogatepass")
            except UnicodeDecodeError:
                text = pending.decode("utf-8", "replace")
            out.append(text.replace(SPACE, _LITERAL))
            pending = bytearray()

        for i in ids:
            value = self.byte_of.get(i)
            if value is not None:
                pending.append(value)
                continue
            bytes_so_far()
            if i is None or not 0 <= i < len(self.pieces):
                out.append("\ufffd")
            elif self.pieces[i] in own:
                out.append(self.pieces[i])
        bytes_so_far()
        text = "".join(out).replace(SPACE, " ").replace(_LITERAL, SPACE)
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def loaded(data: bytes) -> Model:
    """One model per worker process, so that its memos outlive a task."""
    return Model(data)


def encode(
    docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """``doc_id, n_ids, ids, round_trip`` per row (and ``text`` again), without a shuffle.

    ``round_trip`` tells that decoding the ids gives the text back. Whole texts
    are encoded. A null or empty text has no ids. Null ids and repeated rows stay;
    an empty table gives no rows; other columns are not read. The model file is
    read on the driver and sent along: its size is fixed, half a megabyte here.
    """
    with open(model, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]
    schema = pa.schema(fields + [("text", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(data.value)

        def rows():
            for doc, text in rows_of(batches, "doc_id", "text"):
                ids = tokenizer.encode(text)
                row = (doc, len(ids), memory(ids), tokenizer.decode(ids) == text)
                yield (*row, text) if with_text else row

        yield from batched(rows(), schema, 200)

    ddl = "doc_id long, n_ids long, ids array<int>, round_trip boolean" + ", text string" * with_text
    return texts(docs, id_col, text_col).mapInArrow(run, ddl)


def memory(ids: array):
    """The ids as an array that Arrow reads without a Python object per id."""
    import numpy as np

    return np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids, whether or not they come from ``encode``. No shuffle.

    A null array decodes to an empty text; ids that are null or beyond the model, and bytes that are no
    UTF-8, to U+FFFD; control ids to nothing. Null document ids and repeated rows stay; an empty table gives
    no rows; other columns are not read.
    """
    with open(model, "rb") as file:
        data = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(data.value)
        rows = ((doc, tokenizer.decode_any(ids or [])) for doc, ids in rows_of(batches, "doc_id", "ids"))
        yield from batched(rows, schema, 200)

    chosen = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, text string")
