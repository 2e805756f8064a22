"""The store of last writes: equal to the whole log, flat reads, repeats, lost runs."""

import random

from casewell.streaming import snapshots

KIND = "complaint_id string, seq bigint, level string"


def batches(count, keys, seed=1):
    pick = random.Random(seed)
    seqs = list(range(count * 40))
    pick.shuffle(seqs)  # numbers come in any order
    for b in range(count):
        yield [(pick.choice([None, *(f"k{i}" for i in range(keys))]), s, f"L{s % 5}")
               for s in seqs[b * 40:(b + 1) * 40]]


def last(rows):
    out = {}
    for key, seq, level in rows:
        if key not in out or seq > out[key][0]:
            out[key] = (seq, level)
    return {(k, *v) for k, v in out.items()}


def found(spark, store, schema, **options):
    return {tuple(r) for r in snapshots.read_latest(spark, store, schema, **options).collect()}


def test_store_equals_the_log_and_reads_stay_flat(spark, tmp_path):
    store, seen, sizes = str(tmp_path / "store"), [], []
    schema = spark.createDataFrame([], KIND).schema
    assert found(spark, store, schema) == set()
    for b, rows in enumerate(batches(50, 30)):
        snapshots.upsert_batch(spark.createDataFrame(rows, KIND).coalesce(2), b, store, every=5,
                               files=2)
        seen += rows
        if b in (9, 49):  # as many batches after a snapshot
            sizes.append(snapshots.bytes_to_read(spark, store, schema))
    assert found(spark, store, schema) == last(seen)
    assert sizes[1] <= 1.2 * sizes[0]  # the same keys, forty batches later
    # the state before an earlier batch can still be read
    assert found(spark, store, schema, before=48) == last(seen[:48 * 40])


def test_repeated_and_lost_batches(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []
    schema = spark.createDataFrame([], KIND).schema
    for b, rows in enumerate(batches(6, 10, seed=2)):
        for _ in range(2):  # each batch comes twice, also those that make a snapshot
            snapshots.upsert_batch(spark.createDataFrame(rows, KIND).coalesce(1), b, store,
                                   every=3, files=1)
        seen += rows
        assert found(spark, store, schema) == last(seen)
    assert snapshots.newest_snapshot(spark, store) == (5, "snapshot/upto=5")
    # a snapshot without its row in the manifest does not count
    spark.createDataFrame([("k1", 10**9, "lost")], KIND).write.parquet(f"{store}/snapshot/upto=9")
    assert found(spark, store, schema) == last(seen)
    # an empty batch changes nothing
    snapshots.upsert_batch(spark.createDataFrame([], KIND), 6, store, every=3)
    assert found(spark, store, schema) == last(seen)
