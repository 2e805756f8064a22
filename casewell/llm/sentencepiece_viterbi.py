"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces is read once over the text. At each position the
output links give every piece that ends there, from the longest to its suffixes, and each
relaxes the best score of a segmentation up to the position (Viterbi). Characters that no piece
covers become bytes. A border between two characters that no piece holds side by side is a border
of every segmentation, so texts are cut there and the parts are encoded one by one and
remembered."""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The sign for a space, the penalty below the worst score for a character without a piece, and
#: remembered parts of a worker.
SPACE, PENALTY, MEMO_WORDS = "▁", 10.0, 500_000

ENCODED = "doc_id bigint, n_tokens bigint, n_bytes_tokens bigint, ids array<int>, same boolean"


class Pieces:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = []
        self.scores: dict[int, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = model.unk_id()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text.append(piece)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[i] = model.get_score(i)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.worst = min(self.scores.values(), default=0.0) - PENALTY


class Automaton:
    """Aho-Corasick: a trie with failure links; an output link leads from a state to the next
    shorter piece that ends there. `ends` holds, for each state, the (length, id, score) met on
    its output links, the longest first."""

    def __init__(self, pieces: dict[int, str], scores: dict[int, float]):
        self.next: list[dict[str, int]] = [{}]
        self.piece = [-1]
        self.length = [0]
        for i, text in pieces.items():
            state = 0
            for c in text:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                    self.length.append(self.length[state] + 1)
                state = self.next[state][c]
            self.piece[state] = i
        self.fail, self.out = [0] * len(self.next), [0] * len(self.next)
        self.ends: list[tuple] = [()] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            own, i = self.ends[self.out[state]], self.piece[state]
            self.ends[state] = ((self.length[state], i, scores[i]), *own) if i >= 0 else own
            for c, to in self.next[state].items():
                fail = self.fail[state]
                while fail and c not in self.next[fail]:
                    fail = self.fail[fail]
                self.fail[to] = self.next[fail].get(c, 0)
                link = self.fail[to]
                self.out[to] = link if self.piece[link] >= 0 else self.out[link]
                todo.append(to)


class Encoder(dict):
    """Ids (little-endian 32 bits) of a part of a text, remembered."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.table = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of
                      else t.replace(SPACE, " ").encode() for i, t in enumerate(pieces.text)]
        self.lossy = False  # whether the last text holds a part that decodes otherwise
        texts = {i: pieces.text[i] for i in pieces.scores}
        self.automaton = Automaton(texts, pieces.scores)
        self.beside = {t[k:k + 2] for t in texts.values() for k in range(len(t) - 1)}
        inner = any(SPACE in t.lstrip(SPACE) for t in texts.values())
        joined = re.escape("".join(sorted({c for pair in self.beside for c in pair} - {SPACE})))
        # parts: signs and the characters that pieces join, signs alone, or one other character
        self.parts = re.compile(
            f"[{SPACE}{joined}]+|[^{SPACE}{joined}]" if inner else
            f"{SPACE}*[{joined}]+|{SPACE}+|[^{SPACE}{joined}]" if joined else "(?s:.)")

    def segment(self, text: str) -> list[int]:
        """Ids of the segmentation with the best sum of scores; -1 for a character without
        piece. Of equal scores the one whose last piece is longest stays."""
        step, fail, ends = self.automaton.next, self.automaton.fail, self.automaton.ends
        worst = self.pieces.worst
        best, sizes, taken = [0.0], [1], [-1]
        state = at = 0
        for c in text:
            while state and c not in step[state]:
                state = fail[state]
            state = step[state].get(c, 0)
            top, length, piece = best[at] + worst, 1, -1
            at += 1
            seen = False
            for size, i, score in ends[state]:
                score += best[at - size]
                if score > top or (not seen and size == 1 and score >= top):
                    top, length, piece = score, size, i
                seen = True
            best.append(top)
            sizes.append(length)
            taken.append(piece)
        ids = []
        while at:
            ids.append(taken[at])
            at -= sizes[at]
        return ids[::-1]

    def word(self, text: str) -> list[int]:
        """Ids of a word; characters without piece as bytes, or as unknown without byte ids."""
        ids, at = [], 0
        for i in self.segment(text):
            if i >= 0:
                ids.append(i)
                at += len(self.pieces.text[i])
                continue
            found = [self.pieces.bytes.get(b) for b in text[at].encode("utf-8", "surrogatepass")]
            ids += [self.pieces.unknown] if None in found else found
            at += 1
        return ids

    def cut(self, part: str) -> list[str]:
        """The part cut wherever no piece holds the two characters side by side."""
        borders = [at for at, pair in enumerate(map(add, part, part[1:]), 1)
                   if pair not in self.beside]
        return [part[i:j] for i, j in zip([0, *borders], [*borders, len(part)], strict=True)]

    def __missing__(self, part: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        smaller = self.cut(part)
        if len(smaller) > 1:
            before, self.lossy = self.lossy, False
            found = b"".join(map(self.__getitem__, smaller))
            broken = self.lossy
            self.lossy |= before
        else:
            ids = self.word(part)
            found = struct.pack(f"<{len(ids)}i", *ids)
            broken = b"".join([self.table[i] for i in ids]) != part.replace(SPACE, " ").encode(
                "utf-8", "surrogatepass")
            self.lossy |= broken
        if len(part) <= 64 and not broken:  # a broken part comes here each time it occurs
            self[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: spaces become their sign and one is put in front. `lossy` then says
        whether decoding gives another text."""
        self.lossy = False
        if not text:
            return np.zeros(0, "<i4")
        parts = self.parts.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), "<i4")


def decode(pieces: Pieces, ids) -> str:
    """The text of ids: pieces and runs of bytes joined, signs as spaces, without the one put in
    front. Bytes that are no UTF-8 become the replacement character."""
    out = bytearray()
    for i in ids:
        byte = pieces.byte_of.get(i)
        if byte is None:
            out += pieces.text[i].replace(SPACE, " ").encode("utf-8")
        else:
            out.append(byte)
    text = out.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        encoder = Encoder(pieces)
        as_bytes = np.zeros(len(pieces.text), bool)
        as_bytes[list(pieces.byte_of)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 500):
                part = texts[k:k + 500]
                ids, same = [], []
                for t in part:
                    ids.append(encoder.encode(t))
                    same.append(not encoder.lossy)
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, len(part)),
                     pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([int(as_bytes[x].sum()) for x in ids], pa.int64()),
                     pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else []),
                     pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "n_bytes_tokens", "ids", "same"])
    return run


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_bytes_tokens (ids of single bytes), ids, and
    whether decoding gives the text back.

    A null or empty text has no ids. Repeated rows are encoded alike. `same` is false only where
    a character has neither piece nor bytes; the space sign itself counts as a space. Whole
    texts are encoded; other columns are not looked at. `model_path` is a file that every
    executor has."""
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(_encoder(model_path), ENCODED))


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([decode(pieces, x or []) for x in
                                            batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])
    return (encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids"))
            .mapInArrow(run, "doc_id bigint, text string"))
