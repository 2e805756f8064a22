"""Language identification by cross-parsing against suffix automata.

A suffix automaton of labelled text is built for each language. A text is parsed greedily into
longest matches with each of them; the language that needs the fewest phrases per symbol wins.
All blocks of many texts walk an automaton in step: its transitions, with the restart at the
root where a match ends, are one table that numpy reads."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The bounded training sample: texts for each language, symbols taken from each text, and
#: languages at most. 200 x 160 symbols a language are an automaton of about 50,000 states.
TEXTS, SYMBOLS, LANGUAGES = 200, 160, 64
#: Distinct letters with codes of their own; the others share one.
LETTERS = 120
#: Symbols parsed in one walk. A text is cut into blocks of this many symbols, each parsed from
#: the root, so that long and short texts are parsed alike.
BLOCK = 256

PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def letters_only(text: str) -> str:
    """Lower-case letters, with one space for every other run of characters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int], size: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence of codes below `size`, -1 for none."""
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out = np.full((len(step), size), -1, np.int32)
    for state, to in enumerate(step):
        for c, target in to.items():
            out[state, c] = target
    return out


def parse_table(automaton: np.ndarray) -> np.ndarray:
    """Greedy parsing as one table: entry (state, code) is twice the offset of the next state's
    row plus 1 if the code begins a phrase: no match continues with it, or the walk stands at the
    root, after a code that is unknown there and so a phrase of its own."""
    states, size = automaton.shape
    root = automaton[0]
    following = np.where(automaton >= 0, automaton, np.where(root >= 0, root, 0)[None, :])
    begins = automaton < 0
    begins[0] = True
    return (following.astype(np.int64) * size * 2 + begins).astype(np.int32).ravel()


class Model:
    """Symbol codes and a parse table for each language."""

    def __init__(self, samples: dict[str, list[str]], letters: int = LETTERS):
        counts: dict[str, int] = {}
        for texts in samples.values():
            for text in texts:
                for c in text:
                    counts[c] = counts.get(c, 0) + 1
        own = sorted((c for c in counts if c != " "), key=lambda c: (-counts[c], c))[:letters]
        self.size = len(own) + 3  # 0 filler, 1 space, 2 other letters
        self.codes = {c: k + 3 for k, c in enumerate(own)} | {" ": 1}
        self.languages = sorted(samples)
        self.tables = []
        for lang in self.languages:
            joined = [self.codes.get(c, 2) for text in samples[lang] for c in text + " "]
            self.tables.append(parse_table(suffix_automaton(joined, self.size)))

    def code_of_points(self) -> np.ndarray:
        """Code of each Unicode code point: letters, and 1 for everything else."""
        out = np.ones(0x110000, np.uint8)
        for point in range(0x110000):
            if chr(point).isalpha():
                out[point] = 2
        for c, k in self.codes.items():
            out[ord(c)] = k
        return out


def phrases(model: Model, points: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text with each language (texts x languages), and symbols of each text."""
    count = np.zeros((len(texts), len(model.languages)))
    raw = np.frombuffer("".join(t.lower() + "\n" for t in texts).encode("utf-32-le",
                                                                     "surrogatepass"), np.uint32)
    code = points[raw]
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(0, ends)))
    keep = np.ones(len(code), bool)  # one space for a run, none at the start of a text
    keep[1:] = ~((code[1:] == 1) & (code[:-1] == 1))
    first = np.append(0, ends[:-1]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    keep[first] &= code[first] != 1
    code, owner = code[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(sizes) - sizes
    blocks = -(-sizes // BLOCK)
    who = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = begin[who] + nth * BLOCK
    length = np.minimum(BLOCK, sizes[who] - nth * BLOCK)
    for k in range(0, len(who), 8192):
        s, n, w = start[k:k + 8192], length[k:k + 8192], who[k:k + 8192]
        order = np.argsort(-n, kind="stable")
        s, n, w = s[order], n[order], w[order]
        live = np.searchsorted(-n, -np.arange(BLOCK), side="left")  # blocks longer than j
        grid = [code[s[:live[j]] + j].astype(np.int32) for j in range(int(n[0]))]
        for l, table in enumerate(model.tables):
            state, begun = np.zeros(len(s), np.int32), np.zeros(len(s), np.int32)
            for column in grid:
                m = len(column)
                value = table[state[:m] + column]
                begun[:m] += value & 1
                state[:m] = value >> 1
            np.add.at(count[:, l], w, begun)
    return count, sizes


def _predictor(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, points = shipped.value
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(2).to_pylist()
            for k in range(0, len(texts), 1000):
                part = texts[k:k + 1000]
                count, sizes = phrases(model, points, part)
                for text, row in zip(part, count, strict=True):
                    if not model.languages or not any(c.isalpha() for c in text):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(row.argmin())
                    weights = np.exp2(row.min() - row)  # a phrase less is twice as likely
                    langs.append(model.languages[best])
                    scores.append(float(weights[best] / weights.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                 pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int,
           symbols: int) -> dict[str, list[str]]:
    """The bounded training sample: for each language up to `texts` rows, chosen by hash of the
    text among rows with label that are not held out, and `symbols` letters from the middle of
    each. One row is chosen in each of `texts` hash buckets, so a hot language is combined before
    the shuffle like any other."""
    marked = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                         F.xxhash64(F.col(text_col)).alias("h"), held_out(id_col).alias("out"))
    labelled = marked.where("not coalesce(out, false) and lang is not null and text is not null")
    chosen = labelled.groupBy("lang", F.pmod("h", F.lit(texts)).alias("bucket")).agg(
        F.min("h").alias("h"))
    known = chosen.select("lang").distinct().limit(LANGUAGES + 1).count()
    if known > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: raise the documented bound")
    span = 4 * symbols  # characters, of which about half are letters kept
    rows = (labelled.join(F.broadcast(chosen.drop("bucket")), ["lang", "h"], "left_semi")
            .groupBy("lang", "h").agg(F.first(F.substr(
                "text", F.greatest(F.lit(1), (F.length("text") / 2 - span / 2).cast("int")),
                F.lit(span))).alias("text")).orderBy("lang", "h").collect())
    out: dict[str, list[str]] = {}
    for row in rows:
        found = letters_only(unicodedata.normalize("NFC", row.text))[:symbols]
        if found:
            out.setdefault(row.lang, []).append(found)
    return out


def predict_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", texts: int = TEXTS, symbols: int = SYMBOLS,
                     train: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from a bounded sample of the labelled rows of `train` (or `docs`) that are not held
    out. A text that is null or has no letter, and any text where nothing was learned, is `und`
    with score 0. Fewest phrases win, ties go to the first label in order; the score is the
    share of the winner when each phrase less counts twice. Rows without id are never held
    out. Whole texts are parsed; other columns are not looked at."""
    model = Model(sample(train if train is not None else docs, id_col, text_col, lang_col,
                         texts, symbols))
    # bounded by the sample: TEXTS x SYMBOLS symbols for each of at most LANGUAGES languages
    shipped = docs.sparkSession.sparkContext.broadcast((model, model.code_of_points()))
    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                        text_of(text_col).alias("text"))
            .mapInArrow(_predictor(shipped), PREDICTED))
