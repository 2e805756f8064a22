"""Maximal periodic runs of words by recompression.

The words of many documents are numbered and laid end to end, with a number of its own before and
after each document. Recompression turns this sequence into a run-length grammar, level by level:

- block compression replaces each stretch of one repeated symbol by a symbol for (symbol, length);
- pair compression deals the symbols into two halves by a hash and replaces each neighbouring pair
  (first half, second half) by a symbol for the pair.

Equal stretches of words are compressed alike except near their borders, so that the longest
common extension of two positions climbs from level to level while symbols agree and comes down
again to the first difference: a bounded number of steps a level, of which there are logarithmically
many. All questions of a block of documents climb together.

A run of period p that is long enough holds both ends of a step of p from some point of the grid
of multiples of max(least - p, (power - 1) * p). So each period asks only at its own grid points
(the grids of all periods have n log n points); where the two words are equal, the extensions to
the right and to the left give the exact borders."""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: A run has at least so many words, and at least so many periods.
LEAST, POWER = 24, 3
#: Words compressed together (one document at least), and grid points looked at together.
BLOCK_WORDS, BLOCK_POINTS = 400_000, 2_000_000
#: The grammar ends at a level of so few symbols; the rest is compared one by one.
TOP_SYMBOLS = 32

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass
class Level:
    """Symbols of a level; for those of the next one, where the first child of each is (and the
    end), and for each symbol here its parent."""

    symbols: np.ndarray
    blocks: bool = False
    children: np.ndarray | None = None
    parents: np.ndarray | None = None


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels from the sequence up. Symbols are numbers from 0."""
    levels = [Level(symbols.astype(np.int64))]
    names = int(symbols.max(initial=-1)) + 1
    turn = 0
    while len(s := levels[-1].symbols) > TOP_SYMBOLS:
        same = s[1:] == s[:-1]
        if same.any():
            begins = np.concatenate([[True], ~same])
            children = np.flatnonzero(begins)
            lengths = np.diff(np.append(children, len(s)))
            following = s[children]
            long = lengths > 1
            new, at = np.unique(following[long] * (len(s) + 1) + lengths[long],
                                return_inverse=True)
            following[long] = names + at
            names += len(new)
            levels[-1].blocks = True
        else:
            turn += 1
            # the top bit of a product with an odd number that differs at each level
            second = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(
                (0x9E3779B97F4A7C15 * (2 * turn + 1)) % (1 << 64)) >> np.uint64(63) == 1
            joined = ~second[:-1] & second[1:]
            if not joined.any():
                if turn > 1000:  # cannot happen by chance
                    break
                continue
            begins = np.concatenate([[True], ~joined])
            children = np.flatnonzero(begins)
            following = s[children]
            pairs = np.flatnonzero(np.append(joined, False)[children])
            new, at = np.unique(following[pairs] * names + s[children[pairs] + 1],
                                return_inverse=True)
            following[pairs] = names + at
            names += len(new)
        levels[-1].children = np.append(children, len(s))
        levels[-1].parents = np.cumsum(begins) - 1
        levels.append(Level(following))
    return levels


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols agree from positions a and b on, to the right (step 1) or to the left
    (step -1). The first and the last symbol of the sequence are each alone of their kind, and
    a < b."""
    a, b, origin = a.copy(), b.copy(), a.copy()
    stopped: list[list[np.ndarray]] = [[] for _ in levels]  # questions that differ at a level
    asked = np.arange(len(a))

    def left_in(level: Level, at: np.ndarray) -> np.ndarray:
        """Symbols from `at` to the end of its parent, in the direction asked."""
        parent = level.parents[at]
        return (level.children[parent + 1] - at if step > 0 else at - level.children[parent] + 1)

    for k, level in enumerate(levels[:-1]):  # climb
        same = level.symbols[a[asked]] == level.symbols[b[asked]]
        stopped[k].append(asked[~same])
        asked = asked[same]
        if not len(asked):
            break
        x, y = a[asked], b[asked]
        px, py = level.parents[x], level.parents[y]
        edge = (lambda p: level.children[p]) if step > 0 else (
            lambda p: level.children[p + 1] - 1)
        inside = (x != edge(px)) | (y != edge(py))
        m, n = left_in(level, x), left_in(level, y)
        move = np.where(inside, np.minimum(m, n), 0)
        a[asked], b[asked] = x, y = x + step * move, y + step * move
        parted = inside & (m != n)  # one block goes on, the other has ended
        stopped[k].append(asked[parted])
        asked, x, y = asked[~parted], x[~parted], y[~parted]
        a[asked], b[asked] = level.parents[x], level.parents[y]
    else:
        top = levels[-1].symbols  # few symbols
        while len(asked):
            same = top[a[asked]] == top[b[asked]]
            stopped[-1].append(asked[~same])
            asked = asked[same]
            a[asked] += step
            b[asked] += step

    going = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):  # come down
        if len(going):
            level = levels[k]
            shift, back = (0, 0) if step > 0 else (1, 1)
            x = level.children[a[going] + shift] - back
            y = level.children[b[going] + shift] - back
            same = level.symbols[x] == level.symbols[y]
            move = np.minimum(left_in(level, x), left_in(level, y)) if level.blocks else 1
            move = np.where(same, move, 0)
            a[going], b[going] = x + step * move, y + step * move
        going = np.concatenate([going, *stopped[k]])
    return np.abs(a - origin)


_GRIDS: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}


def _grid(size: int, least: int, power: int, low: int, high: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """Grid points i and periods p from low to high - 1 with i + p < size, by i + p."""
    periods = np.arange(low, high)
    steps = np.maximum(np.maximum(least - periods, (power - 1) * periods), 1)
    counts = np.maximum((size - periods + steps - 1) // steps, 0)
    p, s = np.repeat(periods, counts), np.repeat(steps, counts)
    i = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * s
    order = np.argsort(i + p, kind="stable")
    return i[order].astype(np.int32), p[order].astype(np.int32)


def _points(words: np.ndarray, least: int, power: int) -> Iterator[tuple]:
    """Grid points of a document where the words a period apart are equal."""
    n = len(words)
    if n < max(least, power):
        return
    size = 1 << max(n - 1, 1).bit_length()
    if size <= 1 << 16:  # the grid of the next power of two serves all shorter documents
        key = (size, least, power)
        if key not in _GRIDS:
            i, p = _grid(size, least, power, 1, size // power + 1)
            _GRIDS[key] = i, p, np.searchsorted(i + p, np.arange(size + 1))
        i, p, ends = _GRIDS[key]
        i, p = i[:ends[n]], p[:ends[n]]
        hit = words[i] == words[i + p]
        yield i[hit], p[hit]
        return
    low = 1
    while low <= n // power:  # a long document asks for some periods at a time
        step = max(least - low, (power - 1) * low)
        high = min(low + max(BLOCK_POINTS * step // n, 1), n // power + 1)
        i, p = _grid(n, least, power, low, high)
        hit = words[i] == words[i + p]
        yield i[hit], p[hit]
        low = high


def find_runs(texts: list[np.ndarray], least: int = LEAST, power: int = POWER
              ) -> list[np.ndarray]:
    """Runs (start, length, smallest period) of each sequence of numbers, by start and period."""
    names = 1 + max((int(t.max(initial=-1)) for t in texts), default=-1)
    parts, begins, at = [np.array([names])], [], 1
    for k, t in enumerate(texts):
        begins.append(at)
        parts += [t, np.array([names + 1 + k])]
        at += len(t) + 1
    found: list[np.ndarray] = []
    levels = None

    def ask(points: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        nonlocal levels
        levels = levels or grammar(np.concatenate(parts))
        document = np.repeat([d for d, _, _ in points], [len(i) for _, i, _ in points])
        begin = np.array(begins)[document]
        period = np.concatenate([p for _, _, p in points]).astype(np.int64)
        i = np.concatenate([i for _, i, _ in points]) + begin
        right = extensions(levels, i, i + period, 1)
        left = extensions(levels, i - 1, i + period - 1, -1)
        length = left + right + period
        run = length >= np.maximum(least, power * period)
        rows = np.stack([document, i - left - begin, length, period], axis=1)[run]
        if len(rows):  # a run is found for multiples of its period too: the smallest one stays
            found.append(_smallest(rows))

    points, held = [], 0
    for d, words in enumerate(texts):
        for i, p in _points(words, least, power):
            if len(i):
                points.append((d, i, p))
                held += len(i)
            if held >= BLOCK_POINTS:
                ask(points)
                points, held = [], 0
    if points:
        ask(points)
    rows = _smallest(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    ends = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in itertools.pairwise(ends)]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) with the smallest period of each stretch."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    other = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
    return rows[np.concatenate([[True], other])]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(itertools.compress(words, (np.cumsum(covered)[:-1] == 0).tolist()))


def _finder(least: int, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            split: list[list[bytes]] = []
            held = done = 0
            for k in range(len(texts)):
                split.append(texts[k].as_py().split())
                held += len(split[-1])
                if held >= BLOCK_WORDS or k == len(texts) - 1:
                    yield rows(ids.slice(done, len(split)), split)
                    done, split, held = k + 1, [], 0

    def rows(ids: pa.Array, split: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        number = [np.frombuffer(array("i", [numbers.setdefault(w, len(numbers)) for w in words]),
                                np.int32) for words in split]
        found = find_runs(number, least, power)
        flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat.T],
                                          names=["start", "length", "period"])
        ends = np.cumsum([0, *map(len, found)])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(list(map(len, split)), pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
             pa.array([collapse(w, r) for w, r in zip(split, found, strict=True)]).cast(
                 pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text: its maximal runs of `power` smallest
    periods and `least` words at least, by start and period, and the words that are left when each
    run keeps its first period, joined by one space.

    Words are what stands between ASCII white space. A null, empty or blank text has no words and
    no runs. Repeated rows stay, ids keep their type and may be null. An empty table gives an
    empty result; other columns are not looked at and may clash. A task holds one text and a block
    of some 400,000 words at a time; a longer text is a block of its own."""
    if power < 2:
        raise ValueError("a run needs two periods")
    kind = docs.select(id_col).dtypes[0][1]
    return (docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
            .mapInArrow(_finder(least, power),
                        f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string"))
