"""Deterministic sharded WARC archives.

1. Digest, size and compressed size of every payload are computed where the pages are read.
2. The record with the smallest page id of equal payloads is a response, the others revisit it.
3. Records are sorted by page id; a running sum of compressed sizes cuts the order into files,
   so that the content of a file depends on the data alone, not on tasks or retries.
4. Pages are shuffled once to their files. A task sorts its records, regenerates headers and
   digests, writes each file under a temporary name, and renames it when it is complete. A
   manifest of files with sizes and digests is written last and commits the archive.

A repeated task writes the same bytes under the same names. Readers go by the manifest."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes

#: Compressed bytes at which a file is full, bytes reckoned for headers, and the fixed date.
ROLL_BYTES, HEADER_BYTES, DATE = 64 << 20, 400, "2024-01-01T00:00:00Z"
#: Files at most, so that their bounds stay small on executors.
MOST_FILES = 1_000_000
#: Tasks that read an archive, at most.
READ_TASKS = 10_000

MEASURED = "page_id bigint, uid bigint, digest string, payload_bytes bigint, packed bigint"
WRITTEN = "file string, records bigint, bytes bigint, sha256 string"
RECORDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, file string")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             pa.array([payload_digest(x) for x in pages], pa.string()),
             pa.array([len(x) for x in pages], pa.int64()),
             pa.array([len(zlib.compress(x, 6)) for x in pages], pa.int64())],
            names=["page_id", "uid", "digest", "payload_bytes", "packed"])


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no block and names the record it revisits."""
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(
            r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}",
              f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest)}",
                  f"X-Refers-To-Page: {'' if refers_to is None else refers_to}",
                  f"X-Payload-Length: {len(payload)}"]
    lines += [f"X-Page: {'' if page_id is None else page_id}", "Content-Type: text/html",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = f"software: record writer\r\nformat: WARC/1.1\r\nfilename: {name}\r\n".encode()
    return "\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, '')}",
                        f"WARC-Date: {DATE}", "Content-Type: application/warc-fields",
                        f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by file, page and kind: the verdict of a page comes before it."""
        store, root = _open(folder)
        attempt = TaskContext.get().taskAttemptId()
        file, sink, name, out = None, None, "", []
        verdicts: dict = {}

        class Counted:
            """A file that hashes and counts what is written."""

            def __init__(self, path):
                self.path, self.stream = path, store.open_output_stream(path, compression=None)
                self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0

            def member(self, data: bytes) -> None:
                packed = io.BytesIO()
                with gzip.GzipFile(fileobj=packed, mode="wb", compresslevel=6, mtime=0) as z:
                    z.write(data)
                packed = packed.getvalue()
                self.stream.write(packed)
                self.sha.update(packed)
                self.bytes += len(packed)

        def close() -> None:
            if sink is not None:
                sink.stream.close()
                store.move(sink.path, f"{root}/{name}")
                out.append((name, sink.records, sink.bytes, sink.sha.hexdigest()))

        for batch in batches:
            for no, page_id, uid, url, page, digest, first, revisit in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if no != file:
                    close()
                    file, name = no, f"pages-{no:08d}.warc.gz"
                    sink, verdicts = Counted(f"{root}/.{name}.{attempt}.tmp"), {}
                    sink.member(_info(name))
                if page is None:
                    verdicts = {uid: (digest, first, revisit)}  # its pages follow, repeated ones too
                    continue
                digest, first, revisit = verdicts[uid]
                sink.member(record(page_id, url, page, digest, first, revisit))
                sink.records += 1
        close()
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["file", "records", "bytes", "sha256"])
    return run


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write an archive into `folder`, which all executors reach; returns its manifest.

    A null page is an empty payload; a null url has no target line; a null page id sorts before
    all others. Of equal payloads the records with the smallest page id are responses (repeated
    rows with that id all are), others revisit it. A file is full when it has `roll_bytes`
    compressed bytes; a record is never split. An empty table writes an empty manifest."""
    uid = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), uid.alias("uid"),
                        F.col(url_col).cast("string").alias("url"),
                        text_bytes(html_col).alias("page"))
    known = materialize(rows.select("page_id", "uid", "page").mapInArrow(_measure, MEASURED))
    first = materialize(known.groupBy("digest").agg(F.min("page_id").alias("first_id")))
    judged = (known.join(first, "digest").withColumn("revisit", F.coalesce(
        F.col("page_id") != F.col("first_id"), F.lit(False)))
        .withColumn("size", F.when(F.col("revisit"), 0).otherwise(F.col("packed")) + HEADER_BYTES))
    # one row for each (page, content): repeated rows are written as often as they occur
    judged = judged.groupBy("page_id", "uid", "digest", "first_id", "revisit").agg(
        F.sum("size").alias("size"))
    placed = materialize(judged.repartitionByRange("page_id", "uid").withColumn(
        "part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(  # one row a partition
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("size").over(Window.partitionBy("part").orderBy("page_id", "uid")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = materialize(placed.withColumn("within", within - F.col("size"))
                           .join(before.select("part", "before"), "part")
                           .withColumn("no", F.floor((F.col("before") + F.col("within"))
                                                     / roll_bytes)))
    # files are ranges of (page id, uid): the first record of each file bounds it
    starts = numbered.groupBy("no").agg(F.min(F.struct("page_id", "uid")).alias("s")).select(
        "no", "s.*").orderBy("no").limit(MOST_FILES + 1).collect()
    if len(starts) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files: raise roll_bytes")
    lowest = -(1 << 63)
    bounds = [(lowest if r.page_id is None else r.page_id, r.uid) for r in starts]
    numbers = np.array([r.no for r in starts], np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            at = [bisect_right(bounds, (lowest if p is None else p, u)) - 1 for p, u in
                  zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[at], pa.int64()), *batch.columns],
                names=["no", *batch.schema.names])

    plain = rows.mapInArrow(dealt, "no bigint, page_id bigint, uid bigint, url string, page binary")
    both = plain.select("*", F.lit(None).cast("string").alias("digest"),
                        F.lit(None).cast("bigint").alias("first_id"),
                        F.lit(None).cast("boolean").alias("revisit")).unionByName(
        numbered.select("no", "page_id", "uid", F.lit(None).cast("string").alias("url"),
                        F.lit(None).cast("binary").alias("page"), "digest", "first_id", "revisit"))
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    manifest = materialize(
        both.repartition(max(1, min(len(starts), 100_000)), "no")
        .sortWithinPartitions("no", "page_id", "uid", F.isnotnull("page"))
        .mapInArrow(_write(folder), WRITTEN)).orderBy("file")
    names = manifest.select("file", "records", "bytes", "sha256")
    lines = [json.dumps(r.asDict()) for r in names.collect()]  # a line for each file
    temporary = f"{root}/.manifest.json.tmp"
    with store.open_output_stream(temporary) as sink:
        sink.write(("\n".join(lines) + "\n").encode() if lines else b"")
    store.move(temporary, f"{root}/manifest.json")
    return names


def parse_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an opened archive."""
    plain = gzip.GzipFile(fileobj=stream)
    while True:
        line = plain.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one begins")
        headers = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            headers[name.decode().rstrip(":")] = value.decode("utf-8", "surrogatepass")
        block = plain.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError("a record ends early")
        yield headers, block


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in parse_members(stream):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = payload_digest(block)
                        if head["WARC-Block-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{name}: a block does not have its digest")
                        revisit = kind == "revisit"
                        rows.append((
                            int(head["X-Page"]) if head["X-Page"] else None,
                            int(head["X-Payload-Length"]) if revisit else len(block),
                            head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest,
                            kind, int(head["X-Refers-To-Page"])
                            if revisit and head["X-Refers-To-Page"] else None, name))
                        if len(rows) == 5000:
                            yield _records(rows)
                            rows = []
                yield _records(rows)
    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=[x.split()[0] for x in RECORDS.split(", ")])


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files of a manifest: page_id, payload_bytes, payload_digest, record_type,
    refers_to, file. Digests of blocks are checked.

    Files are dealt out in ranges of their names, one file a task up to READ_TASKS
    tasks; the number is given, because rows of a few bytes would otherwise share one task. An
    empty manifest gives no record."""
    files = manifest.agg(F.count(F.lit(1))).first()[0]
    return (manifest.select("file").repartitionByRange(max(1, min(files, READ_TASKS)), "file")
            .mapInArrow(_read(folder), RECORDS))
