"""Exact duplicates by Grace hashing over complete contents.

1. Every map task collapses equal texts of a batch in an open-addressing table, so a hot text
   leaves a task once per batch however many copies it has.
2. The representatives are shuffled by digest. A task streams its bucket into an
   open-addressing table that compares complete contents; when the contents exceed the memory
   limit, the bucket is partitioned into spill files by the next digest bits, recursively, until
   each part fits.
3. Group results join the batches' representatives (a key with at most a batch of rows), which
   are then expanded to documents.

Nothing is collected: a group of any size is a list of bounded batches."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spill_folder, text_bytes

#: Bytes of distinct contents that one table may hold before its bucket is partitioned.
TABLE_BYTES = 64 << 20
#: Digest bits used by each partitioning of a bucket.
FAN_BITS = 4

REPS = "rep bigint, digest binary, content binary, top bigint, top_at int, n int, ids array<bigint>"
GROUPS = "rep bigint, keep_id bigint, keep_rep bigint, group_size bigint"


class ContentTable:
    """Open addressing with linear probing; keys are complete contents.

    The digest gives the first slot and a quick refusal; equality is decided by comparing the
    contents themselves."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.values: list = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "big") & mask
        while (i := self.slots[at]) >= 0:
            if self.digests[i] == digest and self.contents[i] == content:
                return at
            at = (at + 1) & mask
        return at

    def find_or_add(self, digest: bytes, content: bytes) -> int:
        """Number of the entry; a new one has the value None."""
        at = self._slot(digest, content)
        if self.slots[at] >= 0:
            return self.slots[at]
        if 2 * (len(self.contents) + 1) > len(self.slots):
            old = self.digests, self.contents
            self.slots = [-1] * (2 * len(self.slots))
            for i, (d, c) in enumerate(zip(*old, strict=True)):
                self.slots[self._slot(d, c)] = i
            at = self._slot(digest, content)
        self.slots[at] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.values.append(None)
        self.bytes += len(content)
        return len(self.contents) - 1


def _larger(a, b) -> bool:
    """Ids in order, null below all."""
    return b is None and a is not None or (a is not None and b is not None and a > b)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of a batch, with the ids of its copies."""
    number = TaskContext.get().partitionId() << 36
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        found = ContentTable(4096)
        for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   strict=True):
            i = found.find_or_add(hashlib.sha256(content).digest(), content)
            if found.values[i] is None:
                found.values[i] = []
            found.values[i].append(doc_id)
        rows = []
        for digest, content, ids in zip(found.digests, found.contents, found.values, strict=True):
            at = 0
            for i, x in enumerate(ids):
                if _larger(x, ids[at]):
                    at = i
            rows.append((number, digest, pack.compress(content), ids[at], at, len(ids), ids))
            number += 1
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
             pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64()),
             pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.int32()),
             pa.array(columns[6], pa.list_(pa.int64()))],
            names=["rep", "digest", "content", "top", "top_at", "n", "ids"])


def _merge(old, new):
    """(top id, its representative, rows, representatives) of two parts of one group. Of equal
    ids the smaller representative wins, so exactly one row of a group stays."""
    if old is None:
        return new
    best = old if not _larger(new[0], old[0]) and (old[0] != new[0] or old[1] < new[1]) else new
    old[3].extend(new[3])
    return best[0], best[1], old[2] + new[2], old[3]


def grace_groups(rows: Iterator[tuple], limit: int, level: int = 0, folder: str | None = None):
    """Groups of equal contents from (digest, content, (top, top_rep, n, reps)) rows.

    Yields the value of each group. Holds at most about `limit` bytes of contents; more are
    partitioned by the digest bits of this level into spill files and done one by one."""
    found, rows = ContentTable(), iter(rows)
    for digest, content, value in rows:
        i = found.find_or_add(digest, content)
        found.values[i] = _merge(found.values[i], value)
        if found.bytes > limit and len(found.contents) > 1 and (level + 1) * FAN_BITS <= 192:
            break
    else:
        yield from found.values
        return
    fan = 1 << FAN_BITS
    files = [tempfile.TemporaryFile(dir=folder) for _ in range(fan)]
    try:
        def put(digest, content, value):
            bits = int.from_bytes(digest, "big") >> (256 - (level + 1) * FAN_BITS)
            pickle.dump((digest, content, value), files[bits & (fan - 1)], 5)

        for entry in zip(found.digests, found.contents, found.values, strict=True):
            put(*entry)
        del found
        for entry in rows:
            put(*entry)

        def read(file):
            file.seek(0)
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

        for file in files:
            yield from grace_groups(read(file), limit, level + 1, folder)
            file.close()
    finally:
        for file in files:
            file.close()


def _grace_task(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows():
            for b in batches:
                for rep, digest, content, top, n in zip(*(c.to_pylist() for c in b.columns),
                                                        strict=True):
                    yield digest, unpack.decompress(content), (top, rep, n, [rep])

        out: list[tuple] = []
        for top, keep_rep, n, reps in grace_groups(rows(), limit, 0, spill_folder()):
            out.extend((rep, top, keep_rep, n) for rep in reps)
            if len(out) >= 10_000:
                yield _groups(out)
                out = []
        yield _groups(out)
    return run


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns],
        names=["rep", "keep_id", "keep_rep", "group_size"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their complete UTF-8 contents are; a null text is an empty one. The row
    with the largest id of a group stays. A null id is below every other. Rows repeated with the
    same id and text are counted, and exactly one of them stays. An empty table gives an empty
    result. Other columns are not looked at."""
    reps = materialize(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                    text_bytes(text_col).alias("content"))
        .mapInArrow(_collapse, REPS))
    groups = (reps.select("rep", "digest", "content", "top", "n")
              .repartition(F.col("digest"))
              .mapInArrow(_grace_task(table_bytes), GROUPS))
    return (reps.select("rep", "digest", "top_at", "ids").join(groups, "rep")
            .select("*", F.posexplode("ids").alias("at", "doc_id"))
            .select("doc_id", "keep_id", "group_size",
                    ((F.col("rep") == F.col("keep_rep")) & (F.col("at") == F.col("top_at")))
                    .alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of wholly repeated rows one stays."""
    mark = "__content_digest"
    kept = (exact_groups(docs, id_col, text_col).where("kept")
            .select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")))
    marked = docs.withColumn(mark, F.sha2(text_bytes(text_col), 256))
    return (marked.join(kept, marked[id_col].eqNullSafe(kept["__kept_id"])
                        & (marked[mark] == kept["__kept_sha"]))
            .dropDuplicates([id_col, mark]).select(*docs.columns))
