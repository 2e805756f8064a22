"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is a token is taken as
it is; otherwise its bytes form a linked list, and the position of each mergeable pair is put into
the bucket of the rank that the merged token has. A bitmap marks the ranks with entries, words of
64 bits mark the bitmap's words that are not empty, and so on up to one word: the next rank is
found by one find-first-set a level, however many entries wait. An entry whose pair has changed
since is skipped.

- A long pre-token has a queue of its own, whose buckets are heaps of positions: a merge costs the
  logarithm of its bucket, so that millions of bytes take a time in proportion to their number.
- The short pre-tokens of many documents are laid end to end and share one queue, whose buckets
  are arrays: the first position of each pre-token in the bucket of the smallest rank is merged
  at once, the others wait. The order within a pre-token is that of a queue of its own.

Both directions run within map tasks, without a shuffle."""

from __future__ import annotations

import base64
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Pre-tokens that a task remembers (at the bound its memory starts anew), bytes of the longest one
#: that shares a queue, and bytes of text encoded at a time (one text at least).
MEMO_PIECES, SHORT, BLOCK_BYTES = 400_000, 64, 8_000_000
#: A space beside other white space (the pattern's, of all Unicode).
SPACES = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
JOINED_SPACES = f"{SPACES} | {SPACES}"
#: Bits of a word of the bitmap.
WORD_BITS = 6


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a ranks file (base64 of the bytes, a space, the rank)."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class RankQueue:
    """Buckets of entries by rank; `first` gives the smallest rank that has a bucket."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels: list[list[int]] = []
        size = max(ranks, 1)
        while not self.levels or size > 1:
            size = (size + (1 << WORD_BITS) - 1) >> WORD_BITS
            self.levels.append([0] * size)

    def bucket(self, rank: int) -> list:
        """The rank's bucket, a new one if it has none."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            for words in self.levels:
                at = rank >> WORD_BITS
                before = words[at]
                words[at] = before | 1 << (rank & 63)
                if before:
                    break
                rank = at
        return found

    def first(self) -> int | None:
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:  # only the top word can be empty
                return None
            at = (at << WORD_BITS) | ((word & -word).bit_length() - 1)  # find first set
        return at

    def drop(self, rank: int) -> list:
        """Take the bucket out."""
        found = self.buckets.pop(rank)
        for words in self.levels:
            at = rank >> WORD_BITS
            words[at] &= ~(1 << (rank & 63))
            if words[at]:
                break
            rank = at
        return found


class Vocabulary:
    """Ranks, and the rank of each pair of tokens that together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.size = max(ranks.values(), default=0) + 1
        codes = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    codes[left * (self.size + 1) + right] = rank
        self.codes = np.array(sorted(codes) + [np.iinfo(np.int64).max], np.int64)
        self.joined = np.array([codes.get(c, -1) for c in self.codes.tolist()], np.int32)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def pair(self, left, right) -> np.ndarray:
        """Rank of the token that two tokens make, -1 where there is none."""
        code = np.asarray(left, np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.joined[at], -1).astype(np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the smallest rank is merged first, the first one
        among equals."""
        ranks, longest, n = self.ranks, self.longest, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        queue = RankQueue(self.size)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[int | None] = [None] * n  # rank of the pair that begins here

        def look(i: int) -> None:
            """Put the pair at i into its bucket, if it can merge."""
            middle = after[i]
            end = after[middle] if middle < n else n + longest + 1
            rank = ranks.get(piece[i:end]) if end - i <= longest else None
            waiting[i] = rank
            if rank is not None:
                heapq.heappush(queue.bucket(rank), i)

        for i in range(n):
            look(i)
        while (rank := queue.first()) is not None:
            bucket = queue.bucket(rank)
            i = heapq.heappop(bucket)
            if not bucket:
                queue.drop(rank)
            if waiting[i] != rank:  # stale: the pair here has grown or gone
                continue
            gone = after[i]
            after[i] = after[gone]
            waiting[gone] = None
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bits) of many pre-tokens by one queue; none of them is empty."""
        n = sum(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        # position n stands for "none": its token pairs with nothing
        token = np.full(n + 1, self.size, np.int32)
        token[:n] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        last = np.cumsum(sizes) - 1
        after = np.arange(1, n + 2, dtype=np.int32)
        after[last] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[last - sizes + 1] = n
        waiting = np.full(n + 1, -1, np.int32)
        queue = RankQueue(self.size)

        def look(at: np.ndarray) -> None:
            found = self.pair(token[at], token[after[at]])
            waiting[at] = found
            at, found = at[found >= 0], found[found >= 0]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, part in zip(found[np.concatenate([[0], cuts])].tolist() if len(at) else (),
                                  np.split(at, cuts), strict=False):
                queue.bucket(rank).append(part)

        look(np.arange(n, dtype=np.int32))
        while (rank := queue.first()) is not None:
            parts = queue.drop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[waiting[at] == rank]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                again = owner[at[1:]] == owner[at[:-1]]
                if again.any():  # one merge of a pre-token at a time, the first one
                    queue.bucket(rank).append(at[1:][again])
                    at = at[np.concatenate([[True], ~again])]
            gone = after[at]
            token[at], token[gone], waiting[gone] = rank, -1, -1
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            look(np.concatenate([at, left[left < n]]))
        left = np.flatnonzero(token[:n] >= 0)
        ends = 4 * np.cumsum(np.bincount(owner[left], minlength=len(pieces)))
        ids = token[left].astype("<i4").tobytes()
        return [ids[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]


class Encoder:
    """Token ids of many texts; ids of short pre-tokens are remembered.

    Texts whose spaces stand alone between words are cut at the spaces first: the pattern takes
    one space into the word after it and joins no characters over that border. So each
    different word with its space is cut by the pattern once for a block of texts. Other texts
    are cut by the pattern as a whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words, self.pattern = Vocabulary(ranks), pattern
        self.find = regex.compile(pattern).finditer
        self.memo: dict[bytes, bytes] = {}
        self.known: dict[str, str | None] = {}

    def stand_ins(self, chars: set[str]) -> dict[int, str]:
        """Characters that the tokenizer library takes for another class (letter, number, other)
        than this module's regular expressions do, with a character of the right class: the two
        know different editions of Unicode. The library is asked about each one once."""
        new = [c for c in chars - self.known.keys() if c > "\x7f"]
        if new:
            pairs = [(a + c).encode() for a in "a1" for c in new]
            ranks = {bytes([b]): b for b in range(256)} | {
                p: 256 + k for k, p in enumerate(dict.fromkeys(pairs))}
            asked = tiktoken.Encoding("classes", pat_str=self.pattern, mergeable_ranks=ranks,
                                      special_tokens={})
            for c in new:
                theirs, ours = ([one("a" + c), one("1" + c)] for one in (
                    lambda t: len(asked.encode_ordinary(t)) == 1,
                    lambda t: sum(1 for _ in self.find(t)) == 1))
                self.known[c] = (None if theirs == ours else
                                 "a" if theirs[0] else "1" if theirs[1] else "!")
        return {ord(c): s for c in chars if (s := self.known.get(c))}

    def cut(self, text: str, other: dict[int, str]) -> list[str]:
        """Pre-tokens of a text; `other` are its stand-ins."""
        seen = text.translate(other) if other else text
        return [text[m.start():m.end()] for m in self.find(seen)]

    def pieces(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Ids of different pre-tokens, and how many each has."""
        ranks, memo = self.words.ranks, self.memo
        found = [memo.get(p) for p in pieces]
        short, places = [], []
        for k, piece in enumerate(pieces):
            if found[k] is not None:
                continue
            if piece in ranks or len(piece) > SHORT:
                found[k] = np.array(self.words.merge(piece), "<i4").tobytes()
            else:
                short.append(piece)
                places.append(k)
        if short:
            merged = self.words.merge_many(short)
            for k, ids in zip(places, merged, strict=True):
                found[k] = ids
            if len(memo) + len(short) > MEMO_PIECES:
                memo.clear()
            memo.update(itertools.islice(zip(short, merged, strict=True), MEMO_PIECES))
        return found, np.fromiter(map(len, found), np.int64, len(found)) // 4

    def chunks(self, chunks: list[str]) -> pa.ListArray:
        """Ids of each chunk of text."""
        other = self.stand_ins(set().union(*map(set, (c for c in chunks if not c.isascii()))))
        numbers: dict[str, int] = {}
        codes, counts = array("i"), array("i")
        for chunk in chunks:
            if chunk[:1] == " " and chunk[1:].isalpha() and not other:
                codes.append(numbers.setdefault(chunk, len(numbers)))
                counts.append(1)
                continue
            parts = self.cut(chunk, other)
            codes.extend([numbers.setdefault(p, len(numbers)) for p in parts])
            counts.append(len(parts))
        found, sizes = self.pieces([p.encode() for p in numbers])
        pieces = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
            pa.array(np.frombuffer(b"".join(found), "<i4")))
        flat = pieces.take(pa.array(np.frombuffer(codes, np.int32)))
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])
        inner = flat.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(inner[ends], pa.int32()), flat.values)

    def documents(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of whole texts."""
        lone = pc.invert(pc.match_substring_regex(texts, JOINED_SPACES)).to_numpy(False)
        words = pc.split_pattern(pc.if_else(pa.array(lone), texts, ""), " ")
        counts = pc.list_value_length(words).to_numpy()
        first = np.cumsum(counts) - counts
        flat = words.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
        # words after a space, then words that begin a text, then texts cut as a whole
        starts, codes[first] = np.unique(codes[first], return_inverse=True)
        codes[first] += len(names)
        whole = texts.filter(pa.array(~lone)).to_pylist()
        codes[first[~lone]] = len(names) + len(starts) + np.arange(len(whole))
        ids = self.chunks([" " + w for w in names] + [names[k] for k in starts] + whole)
        taken = ids.take(pa.array(codes))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(
            pa.array(taken.offsets.to_numpy()[ends], pa.int32()), taken.values)


def _blocks(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Slices of texts of BLOCK_BYTES or so."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy()) // BLOCK_BYTES
    cuts = np.flatnonzero(ends[1:] != ends[:-1]) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(texts)]):
        if b > a:
            yield texts.slice(a, b - a)


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(read_ranks(path), pattern)
            at = 0
            for texts in _blocks(batch.column(1).cast(pa.string())):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), encoder.documents(texts)],
                    names=["doc_id", "ids"])
                at += len(texts)
    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, without special tokens.

    A null or empty text has no ids. Repeated rows stay. Ids of documents keep their type and
    may be null. An empty table gives an empty result; other columns are not looked at, and
    may clash with the result's. `ranks_path` names a ranks file that every executor has and that
    holds all single bytes."""
    kind = docs.select(id_col).dtypes[0][1]
    return (docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(_encoder(ranks_path, pattern), f"doc_id {kind}, ids array<int>"))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            if tokens is None:
                named = {r: t for t, r in read_ranks(path).items()}
                tokens = pa.array([named.get(i) for i in range(max(named, default=-1) + 1)],
                                  pa.binary())
            lists = batch.column(1)
            flat = lists.flatten()
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
            flat = tokens.take(pc.if_else(known, flat, None))
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy())]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, flat), b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pc.if_else(lists.is_valid(), joined, None)],
                names=["doc_id", "ids", "decoded"])
    return run


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for.

    The bytes of the ids of a text are its UTF-8 bytes; other lists may give bytes that are no
    valid UTF-8, hence binary. No ids give no bytes; null ids, and lists with a null or an id that
    the file does not have, give null. Repeated rows stay, an empty table gives an empty result,
    other columns are not looked at."""
    kind = encoded.select(id_col).dtypes[0][1]
    return (encoded.select(F.col(id_col).alias("doc_id"),
                           F.col(ids_col).cast("array<int>").alias("ids"))
            .mapInArrow(_decoder(ranks_path),
                        f"doc_id {kind}, ids array<int>, decoded binary"))
