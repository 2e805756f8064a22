"""Hierarchical packing of documents into sequences of several context sizes.

Documents are tokenised and packed within each map task, a bounded window of documents at a
time, so that token ids never cross the network. In a window:

- a document longer than the longest context is cut into whole windows of it, and its remainder
  is routed to the shortest tier (1024, 512, 256, ...) that holds it;
- tiers are packed from long to short by best fit; the gaps of long windows take whole documents
  from the same or shorter tiers, and the last gap takes the beginning of a document, which is
  cut there, so that windows are full;
- the last windows of a tier that nothing is left to fill are cut at powers of two.

Full sequences are then dealt to step groups of equal token counts in turn."""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Longest context, tokens of one step group, and documents and ids of one packing window.
CONTEXT, STEP_TOKENS, WINDOW_DOCS, WINDOW_IDS = 1024, 8 * 1024, 20_000, 8_000_000
#: Remembered chunks of a worker; at the bound the memory starts anew.
MEMO_CHUNKS = 400_000

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, tier bigint, step_group bigint")


class Chunks(dict):
    """Token ids (little-endian 32 bits) of a chunk of text, remembered.

    A chunk is a word with the one space before it, or a line break between two words; the
    tokenizer never joins characters over such a border, so chunks are encoded on their own."""

    def __init__(self, ranks_path: str, pattern: str, added: Mapping[str, int]):
        super().__init__()
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > MEMO_CHUNKS:
            self.clear()
        found = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def document(self, text: str) -> bytes:
        """Ids of a whole text; an added token is one id, whatever is around it."""
        if self.parts is None or not self.parts.search(text):
            return self.plain(text)
        return b"".join(np.array([self.added[t]], "<u4").tobytes() if k % 2 else self.plain(t)
                        for k, t in enumerate(self.parts.split(text)) if t)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        parts: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if line.split() != words:  # other or repeated white space, also empty lines
                return self.encode(text)
            if k:
                parts.append("\n")
            parts.append(words[0])
            parts += [" " + w for w in words[1:]]
        return b"".join(map(self.__getitem__, parts))


def pack(lengths: list[int], context: int = CONTEXT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces. Each token is in exactly one piece, no
    sequence is longer than `context`, and each is as long as it or a power of two."""
    tiers = [1 << k for k in range(context.bit_length())]
    done: list[list[tuple[int, int, int]]] = []
    waiting: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for i, n in enumerate(lengths):
        whole = n // context
        done += [[(i, k * context, context)] for k in range(whole)]
        if n % context:
            waiting.append((n % context, i, whole * context))
    waiting.sort()
    while waiting:
        n, i, start = waiting.pop()  # the longest: its tier is the shortest that holds it
        tier = tiers[bisect.bisect_left(tiers, n)]
        sequence, gap = [(i, start, n)], tier - n
        while gap and waiting:
            at = bisect.bisect_right(waiting, (gap, float("inf"), 0))
            if at:  # the longest whole document that fits
                m, j, begin = waiting.pop(at - 1)
            else:  # the shortest is longer than the gap: cut it there
                m, j, begin = waiting.pop(0)
                bisect.insort(waiting, (m - gap, j, begin + gap))
                m = gap
            sequence.append((j, begin, m))
            gap -= m
        if not gap:
            done.append(sequence)
            continue
        total = tier - gap  # nothing is left: cut at powers of two
        for size in reversed(tiers):
            if total & size:
                part, room = [], size
                while room:
                    j, begin, m = sequence[0]
                    take = min(m, room)
                    part.append((j, begin, take))
                    sequence[0] = (j, begin + take, m - take)
                    if take == m:
                        sequence.pop(0)
                    room -= take
                done.append(part)
    return done


def added_tokens(json_path: str) -> dict[str, int]:
    """Tokens that a tokenizer file adds to its vocabulary; they are looked for in a text first."""
    with open(json_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _packer(ranks_path: str, pattern: str, added: Mapping[str, int], end_id: int, context: int,
            step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(ranks_path, pattern, added)
        number = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()
        docs: list = []
        ids: list[bytes] = []

        def window():
            nonlocal number, docs, ids
            rows = []
            filled: dict[int, int] = {}
            for sequence in pack([len(x) // 4 for x in ids], context):
                total = sum(m for _, _, m in sequence)
                # a group is `step` tokens of one tier: sequences go to the group that is open
                group = (filled.get(total, 0) // step) * 64 + total.bit_length()
                filled[total] = filled.get(total, 0) + total
                offset = 0
                for i, start, m in sequence:
                    rows.append((docs[i], start, m,
                                 zlib.crc32(ids[i][4 * start:4 * (start + m)]),
                                 len(ids[i]) // 4, number, offset, total,
                                 (base << 24) + group))
                    offset += m
                number += 1
            docs, ids = [], []
            for k in range(0, len(rows), 50_000):
                columns = zip(*rows[k:k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=[x.split()[0] for x in PIECES.split(", ")])

        held, base = 0, TaskContext.get().partitionId() << 16
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                    strict=True):
                docs.append(doc_id)
                ids.append(chunks.document(text) + end)
                held += len(ids[-1]) // 4
                if len(docs) >= WINDOW_DOCS or held >= WINDOW_IDS:
                    yield from window()
                    held, base = 0, base + 1
        yield from window()
    return run


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT,
                   step_tokens: int = STEP_TOKENS, added: Mapping[str, int] | None = None
                   ) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier (tokens of its sequence, its context size) and step_group.

    A null or empty text is the end id alone. Rows repeated with the same id are documents of
    their own. Sequences are full or as long as a power of two. `ranks_path` names a ranks file
    that every executor has; `added` are further tokens and their ids, which a text may contain. An empty table gives an empty result; other columns are not
    looked at."""
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(_packer(ranks_path, pattern, added or {}, end_id, context,
                                step_tokens), PIECES))
