"""Near duplicates on multisets of word shingles with BagMinHash signatures.

The signature of a weighted set takes, for each register, the earliest point of Poisson processes
owned by the elements. The weight axis of an element is discretised into dyadic blocks [0,1),
[1,2), [2,4), ...; each block has its own process with a rate of its length, split over the
levels it holds, and only points below the element's weight count. Equal registers therefore
have the probability of the weighted Jaccard similarity. Only points up to a time at which all
registers are filled are drawn, so a text costs one draw per shingle and some hundred points.

Bands of the signature give candidates. In each bucket members are compared with a centre, the
text that meets most others, and every candidate is verified on complete multisets. Components
of verified links are found by repeated minimum labels; buckets that still hold several
components are compared again through other centres for as long as that finds links, and small
ones text by text. All texts of larger buckets that then still span components meet once more by
their rarest shingles: two similar texts share one of them, while texts that differ from all
others own them alone. There each text is compared with all texts of other components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: Words in a shingle, least similarity of near duplicates, bands and registers per band.
#: A pair at 0.8 misses all of 24 bands of 4 with probability 3e-6.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
#: Texts, and in larger buckets components, of a bucket that are compared with each other.
PAIRED_PARTS = 32
#: Links that are joined in one task (some 100 MB there).
SMALL_LINKS = 500_000
#: Cells of the sketch of how many texts hold a shingle (8 MB on the driver and in each task), and
#: cells of one row of it.
SKETCH_CELLS, SKETCH_BLOCK = 1 << 20, 1 << 12
#: Texts of a bucket in a block; one block is compared with one block.
BLOCK_TEXTS = 1024

SIGNED = ("uid bigint, doc_id bigint, digest binary, bands array<bigint>, content binary, "
          "sha binary")
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hash of a word, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(content: bytes, memo: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in order; bytes.split() parts at \\x20 and \\x09-\\x0D."""
    words = content.split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted hashes) and how often each occurs. A text of fewer words is
    one shingle; one without words has none."""
    n = len(words)
    if n == 0:
        return words, words.astype(np.int64)
    span = min(size, n)
    total = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        total = _mix(total * _ODD[k % 5] + words[k:n - span + 1 + k])
    total.sort()
    first = np.flatnonzero(np.concatenate(([True], total[1:] != total[:-1])))
    return total[first], np.diff(np.append(first, len(total)))


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int,
               m: int) -> np.ndarray:
    """m registers for each of `docs` weighted sets, each the identity of its earliest point.

    Row i of the inputs is an element of set doc[i] and its weight; every set has elements."""
    top = np.ceil(np.log2(weights)).astype(np.int64)  # last dyadic block of each element
    owner = np.repeat(np.arange(len(elements)), top + 1)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    low = np.where(block == 0, 0.0, 2.0 ** (block - 1))
    rate = np.where(block == 0, 1.0, low)  # the length of the block
    seed = _mix(elements[owner] + _ODD[0] * (block + 1).astype(np.uint64))
    weight, doc = weights[owner].astype(np.float64), doc[owner]
    until = m * (np.log(m) + 3) / np.bincount(doc, np.minimum(weight, low + rate) - low, docs)
    out, filled = np.zeros(docs * m, np.uint64), np.zeros((docs, m), bool)
    while True:
        todo = np.flatnonzero(~filled.all(axis=1)[doc])
        if not len(todo):
            return out.reshape(docs, m)
        s, r, lo, w, d = seed[todo], rate[todo], low[todo], weight[todo], doc[todo]
        end, t = until[d], np.zeros(len(todo))
        places, times, points = [], [], []
        step = 0
        while len(s):
            step += 1
            draw = _mix(s + _U(step) * _ODD[1])
            t = t - np.log(((draw >> _U(11)).astype(np.float64) + 1) * 2.0 ** -53) / r
            live = t <= end
            s, r, lo, w, d, end, t, draw = (
                x[live] for x in (s, r, lo, w, d, end, t, draw))
            place = _mix(draw ^ _ODD[2])
            share = (_mix(place ^ _ODD[3]) >> _U(11)).astype(np.float64) * 2.0 ** -53
            take = lo + np.floor(share * r) < w  # a level of the block that the weight reaches
            places.append((d * m + (place % _U(m)).astype(np.int64))[take])
            times.append(t[take])
            points.append(draw[take])
        place, time, point = map(np.concatenate, (places, times, points))
        best = np.full(docs * m, np.inf)
        np.minimum.at(best, place, time)
        first = time == best[place]
        out[place[first]] = point[first]
        filled |= np.isfinite(best).reshape(docs, m)
        until *= 2


def band_keys(sets: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int,
              most: int = 200_000) -> list[list[int]]:
    """Band keys of each counted multiset, none for an empty one."""
    out: list[list[int]] = [[] for _ in sets]
    full = [i for i, (e, _) in enumerate(sets) if len(e)]
    while full:
        sizes = np.cumsum([len(sets[i][0]) for i in full])
        take = max(1, int(np.searchsorted(sizes, most)))
        now, full = full[:take], full[take:]
        sig = signatures(np.concatenate([sets[i][0] for i in now]),
                         np.concatenate([sets[i][1] for i in now]),
                         np.repeat(np.arange(len(now)), [len(sets[i][0]) for i in now]),
                         len(now), bands * rows).reshape(len(now), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(now), bands))
        for k in range(rows):
            key = _mix(key * _ODD[k % 5] + sig[:, :, k])
        for i, found in zip(now, key.view(np.int64).tolist(), strict=True):
            out[i] = found
    return out


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, memo = TaskContext.get().partitionId() << 36, WordHashes()
        pack = zstandard.ZstdCompressor(level=1)
        with np.errstate(over="ignore"):
            for batch in batches:
                digests, sets, packed, exact = [], [], [], []
                for content in batch.column(1).to_pylist():
                    words = word_hashes(content, memo)
                    digests.append(xxhash.xxh3_128_digest(words.tobytes()))
                    packed.append(pack.compress(content))
                    exact.append(hashlib.sha256(content).digest())
                    sets.append(shingles(words, size))
                keys = band_keys(sets, bands, rows)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(number, number + n), pa.int64()), batch.column(0),
                     pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(packed, pa.binary()), pa.array(exact, pa.binary())],
                    names=["uid", "doc_id", "digest", "bands", "content", "sha"])
                number += n
    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two counted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum() + b[1].sum()) - low
    return low / high if high else 1.0


def _cells(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ _ODD[4]) % _U(SKETCH_CELLS)).astype(np.int64)


def _counted(size: int):
    """How many of a task's texts hold a shingle of each cell, by blocks of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, unpack = WordHashes(), zstandard.ZstdDecompressor()
        often = np.zeros(SKETCH_CELLS, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    e, _ = shingles(word_hashes(unpack.decompress(packed), memo), size)
                    np.add.at(often, _cells(e), 1)
        yield _blocks(np.arange(0, SKETCH_CELLS, SKETCH_BLOCK), often)
    return run


def _blocks(blocks: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(0, len(counts) + 1, SKETCH_BLOCK, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(counts))],
        names=["block", "counts"])


def _added(group: pa.Table) -> pa.Table:
    """The sum of a block's counts; a group has one row for each core."""
    counts = sum(x.values.to_numpy() for x in group["counts"])
    return pa.Table.from_batches([_blocks(group["block"].to_numpy()[:1], counts)])


def _rarest(often, similarity: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, unpack, sketch = WordHashes(), zstandard.ZstdDecompressor(), often.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for uid, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       strict=True):
                    e, w = shingles(word_hashes(unpack.decompress(packed), memo), size)
                    n = sketch[_cells(e)]
                    order = np.lexsort((e, n))
                    e, w, n = e[order], w[order], n[order]
                    total = int(w.sum()) if len(w) else 0
                    rest = total - (np.cumsum(w) - w)
                    # the small number keeps rounding on the side of taking a shingle
                    take = (rest >= similarity * total - 1e-6) & (n > 1)
                    k = int(take.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(e[take].view(np.int64)), pa.array(np.full(k, uid, np.int64)),
                         pa.array(rest[take].astype(np.int64)),
                         pa.array(np.full(k, total, np.int64))],
                        names=["key", "uid", "rest", "total"])
    return run


def rarest(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(key, uid, rest, total): the rarest shingles of each text (uid, content), with the weight
    of the text from this shingle on and in all.

    Shingles are ordered by how many texts hold a shingle of their cell of a sketch of fixed
    size, and by their hash: one order for all texts. Of a text of weight W, those are taken
    after which less than similarity * W is left: two texts of that similarity share one among
    the taken ones of both, in whatever order. A shingle alone in its cell is shared with
    nobody. The sketch only decides how few others share the ones taken."""
    # one task a core: so a block of the sketch has one row for each core
    cores = texts.sparkSession.sparkContext.defaultParallelism
    kind = "block bigint, counts array<bigint>"
    parts = (texts.select("content").coalesce(cores).mapInArrow(_counted(size), kind)
             .groupBy("block").applyInArrow(_added, kind).toPandas())  # SKETCH_CELLS numbers
    often = np.zeros(SKETCH_CELLS, np.int64)
    for block, counts in zip(parts.block, parts.counts, strict=True):
        often[block:block + SKETCH_BLOCK] = counts
    shared = texts.sparkSession.sparkContext.broadcast(often)
    return materialize(texts.select("uid", "content").mapInArrow(
        _rarest(shared, similarity, size), "key bigint, uid bigint, rest bigint, total bigint"))


def _verify(least: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, unpack = WordHashes(), zstandard.ZstdDecompressor()
        last: tuple = (None, None)  # rows of one hub follow each other

        def counted(packed):
            return shingles(word_hashes(unpack.decompress(packed), memo), size)

        with np.errstate(over="ignore"):
            for batch in batches:
                ok = []
                for hub, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                     batch.column(3).to_pylist(), strict=True):
                    if last[0] != hub:
                        last = (hub, counted(y))
                    ok.append(overlap(counted(x), last[1]) >= least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(ok, pa.bool_())],
                    names=["a", "b", "near"])
    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of all links (a, b) of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(list(map(root, ids)), pa.int64())],
        names=["id", "label"])


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id connected with each id of (a, b) links.

    Up to SMALL_LINKS links are joined in one task, which they fit by their number; more of them
    by repeated steps, in which each id takes the smallest label around it."""
    links = materialize(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")))
    if links.count() <= SMALL_LINKS:
        return materialize(links.coalesce(1).mapInArrow(_union, "id bigint, label bigint"))
    edges = materialize(links.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("to")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*"))
    labels = materialize(edges.groupBy("id").agg(F.min("to").alias("near"))
                         .select("id", F.least("id", "near").alias("label")))
    while True:
        seen = (edges.join(labels.select(F.col("id").alias("to"), "label"), "to")
                .groupBy("id").agg(F.min("label").alias("seen")))
        lower = labels.join(seen, "id").select(
            "id", "label", F.least("label", "seen").alias("lower"))
        jump = labels.select(F.col("id").alias("lower"), F.col("label").alias("further"))
        step = materialize(lower.join(jump, "lower").select(
            "id", F.least("lower", "further").alias("label"),
            (F.least("lower", "further") < F.col("label")).alias("moved")))
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            return labels


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                 words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    A class is a component of links between texts whose multisets of five-word shingles have a
    weighted Jaccard similarity of `similarity` or more; class_id is its smallest doc_id, and
    that row is kept. A text of one to four words is a single shingle. Texts with the same words
    are in one class, those without any word (null, empty, white space) too. A null doc_id comes
    after all others; of repeated rows one is kept. An empty table gives an empty result. Other
    columns are not looked at."""
    return _classes(docs, id_col, text_col, similarity, bands, rows, words).drop("sha")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY,
             bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """The rows of near_classes, with the SHA-256 of each text."""
    signed = materialize(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                    text_bytes(text_col).alias("content"))
        .mapInArrow(_sign(bands, rows, words), SIGNED))
    same = materialize(signed.groupBy("digest").agg(F.min("uid").alias("rep")))
    keys = materialize(signed.select("uid", "bands")
                       .join(same.select(F.col("rep").alias("uid")), "uid", "left_semi")
                       .select("uid", F.explode("bands").alias("key")))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = materialize(keys.join(shared, "key"))
    # how many candidates a text meets in all its buckets: an original meets more than its copies
    met = materialize(held.groupBy("uid").agg(F.sum("n").alias("met")))
    held = materialize(held.select("key", "uid").join(met, "uid"))
    texts = materialize(signed.select("uid", "content").join(met.select("uid"), "uid", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("uid").alias("a"), F.col("content").alias("x"))
        right = texts.select(F.col("uid").alias("b"), F.col("content").alias("y"))
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                           .mapInArrow(_verify(similarity, words),
                                       "a bigint, b bigint, near boolean"))

    done, found, turn = None, None, 0
    while True:
        pairs = candidate_pairs(held, found, turn)
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        checked = verified(pairs)
        done = checked if done is None else done.unionByName(checked)
        linked = checked.where("near")
        if turn and linked.isEmpty():
            break
        found, turn = _joined(found, linked), turn + 1
    mixed = _mixed(held, found)
    if not mixed.isEmpty():
        rare = rarest(materialize(texts.join(mixed, "uid", "left_semi")), similarity, words)
        pairs = materialize(rare_pairs(rare, found, similarity)
                            .join(done, ["a", "b"], "left_anti"))
        found = _joined(found, verified(pairs).where("near"))
    classes = (signed.select("uid", "doc_id", "sha", "digest").join(same, "digest")
               .join(found.select(F.col("id").alias("rep"), "label"), "rep", "left")
               .select("uid", "doc_id", "sha", F.coalesce("label", "rep").alias("group")))
    classes = materialize(classes)
    heads = materialize(classes.groupBy("group").agg(
        F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid")).alias("head"),
        F.count("*").alias("class_size")))
    return classes.join(heads, "group").select(
        "doc_id", F.col("head.doc_id").alias("class_id"), "class_size",
        (F.col("uid") == F.col("head.uid")).alias("kept"), "sha")


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (id, label) after further links (a, b)."""
    if found is None:
        return components(links.select("a", "b"))
    for end in ("a", "b"):
        links = (links.join(found.withColumnRenamed("id", end), end, "left")
                 .withColumn(end, F.coalesce("label", end)).drop("label"))
    moved = components(links.where("a <> b").select("a", "b").distinct())
    known = found.select("id", F.col("label").alias("old"))
    new = moved.select(F.col("id").alias("old"), "label")
    # ids that had no link before are their own label
    return materialize(
        known.join(new, "old", "left").select("id", F.coalesce("label", "old").alias("label"))
        .unionByName(moved.join(known.select("id"), "id", "left_anti").select("id", "label")))


def _marked(held: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of buckets with the component `part` of each text."""
    return held.join(found.select(F.col("id").alias("uid"), "label"), "uid", "left").withColumn(
        "part", F.coalesce("label", "uid")).drop("label")


def _parts(marked: DataFrame) -> DataFrame:
    """(key, n, parts, big, big_n): texts and components of each bucket, and its largest one."""
    return (marked.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key")
            .agg(F.sum("n").alias("n"), F.count("*").alias("parts"),
                 F.max(F.struct("n", "part")).alias("m"))
            .select("key", "n", "parts", F.col("m.part").alias("big"),
                    F.col("m.n").alias("big_n")))


def _mixed(held: DataFrame, found: DataFrame) -> DataFrame:
    """uid of the texts in buckets of more than PAIRED_PARTS texts in several components."""
    marked = materialize(_marked(held.select("key", "uid"), found))
    several = _parts(marked).where((F.col("n") > PAIRED_PARTS) & (F.col("parts") > 1))
    return materialize(marked.join(materialize(several), "key", "left_semi")
                       .select("uid").distinct())


def rare_pairs(rare: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b), a > b, of all texts of different components that share a rare shingle and
    can be similar by what is left of both from there on.

    In each bucket the texts outside its largest component are held against all others, in
    blocks of both sides, so that a task has a bounded piece of any bucket. The first shingle
    two texts share leaves at least their overlap on both sides, and texts of similarity s
    overlap by s / (1 + s) of the sum of their weights."""
    marked = materialize(_marked(rare, found))
    several = materialize(_parts(marked).where("parts > 1"))
    sized = materialize(marked.join(several, "key").withColumns({
        "blocks": F.ceil(F.col("n") / BLOCK_TEXTS),
        "few_blocks": F.ceil((F.col("n") - F.col("big_n")) / BLOCK_TEXTS)}))

    def block(blocks: str, salt: int):
        return F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(blocks))

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))

    few = (sized.where("part <> big").withColumn("i", block("few_blocks", 1))
           .select("key", "i", every("blocks").alias("j"), F.col("uid").alias("x"),
                   F.col("part").alias("x_part"), F.col("rest").alias("x_rest"),
                   F.col("total").alias("x_total")))
    each = (sized.withColumn("j", block("blocks", 2))
            .select("key", every("few_blocks").alias("i"), "j", F.col("uid").alias("y"),
                    F.col("part").alias("y_part"), F.col("rest").alias("y_rest"),
                    F.col("total").alias("y_total"), (F.col("part") == F.col("big")).alias("y_big")))
    least = similarity / (1 + similarity) * (F.col("x_total") + F.col("y_total")) - 1e-6
    return (few.join(each, ["key", "i", "j"])
            .where((F.col("x_part") != F.col("y_part")) & (F.col("y_big") | (F.col("x") > F.col("y")))
                   & (F.least("x_rest", "y_rest") >= least))
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())


def candidate_pairs(held: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """Comparisons that buckets with several components still need, as distinct (a, b), a > b.

    Each component of a bucket is compared with one of them, the centre: at first the text that
    meets most others, in later turns another one for each turn. From the second turn on, all
    texts of different components are also compared in buckets of up to PAIRED_PARTS texts, and
    in larger ones one text each of up to PAIRED_PARTS components, a bounded number a row. Turns go on while they find links, so a dense bucket of any size takes work in
    proportion to its members and turns, and never lists its pairs."""
    if found is None:
        parts = held.select("key", F.col("uid").alias("part"), F.struct("met", "uid").alias("m"),
                            F.lit(1).alias("texts"))
    else:
        parts = materialize(
            _marked(held, found).groupBy("key", "part")
            .agg(F.max(F.struct("met", "uid")).alias("m"), F.count("*").alias("texts")))
    order = F.col("m.met") if turn < 2 else F.xxhash64("m.uid", F.lit(turn))
    centres = materialize(parts.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("texts").alias("texts"),
        F.max(F.struct(order.alias("o"), F.col("m.uid").alias("uid"))).alias("c"))
        .where("n > 1").select("key", "n", "texts", F.col("c.uid").alias("centre")))
    sized = parts.drop("texts").join(centres, "key")
    pairs = sized.select(F.col("m.uid").alias("a"), F.col("centre").alias("b"))
    if turn:
        few = (sized.where((F.col("n") <= PAIRED_PARTS) & (F.col("texts") > PAIRED_PARTS))
               .select("key", F.col("m.uid").alias("uid"), "part"))
        small = centres.where(F.col("texts") <= PAIRED_PARTS).select("key")
        few = few.unionByName(_marked(held.join(small, "key", "left_semi"), found)
                              .select("key", "uid", "part"))
        lists = few.groupBy("key").agg(F.collect_list(F.struct("uid", "part")).alias("u"))
        pairs = pairs.unionByName(
            lists.select(F.explode("u").alias("x"), "u").select("x", F.explode("u").alias("y"))
            .where("x.part <> y.part").select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")))
    return (pairs.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept row of each class with all its columns. Rows are told apart by id and text, so
    different texts under one id or a null id are judged each on their own; of rows with the same
    id and text, which are in one class, one stays."""
    mark = "__content_digest"
    kept = (_classes(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias("__kept_id"), F.hex("sha").alias("__kept_sha")))
    marked = docs.withColumn(mark, F.upper(F.sha2(text_bytes(text_col), 256)))
    return (marked.join(kept, marked[id_col].eqNullSafe(kept["__kept_id"])
                        & (marked[mark] == kept["__kept_sha"]))
            .dropDuplicates([id_col, mark]).select(*docs.columns))
