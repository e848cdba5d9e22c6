"""The bucketed online store: merges, replays, retired files, repeated events."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from stockpulse.session import delete_at_end, scratch_path
from stockpulse.sources.io import path_exists
from stockpulse.streaming.online import OnlineStore
from stockpulse.streaming.push import without_repeats

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp, v double, c long, extra string"


def new_store(spark, **kw):
    base = scratch_path(spark, f"test_online/{uuid.uuid4().hex}")
    delete_at_end(spark, base)
    return OnlineStore(base, "k", "ts", ["v"], created="c", **kw)


def frame(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), v, c, "x") for k, h, v, c in rows], SCHEMA)


def state(spark, store, schema):
    return {r["k"]: (r["ts"], r["v"], r["c"]) for r in store.read(spark, schema).collect()}


def files(spark, store, version):
    """bucket -> file names of a version."""
    out = {}
    for bucket, folder in store.manifest(spark, version).items():
        out[bucket] = sorted(spark.read.parquet(f"{store.base}/{folder}").inputFiles())
    return out


def test_merges_equal_a_dictionary(spark):
    rnd, store, plain = random.Random(1), new_store(spark, buckets=8), {}
    schema = frame(spark, []).schema
    assert store.read(spark, schema).count() == 0
    for version in range(5):
        rows = [(rnd.randrange(60), rnd.randrange(100), rnd.random(), rnd.randrange(10**9)) for _ in range(40)]
        store.merge(frame(spark, rows + rows[:5]), version)
        for k, h, v, c in rows:
            if k not in plain or (T0 + dt.timedelta(hours=h), c) > (plain[k][0], plain[k][2]):
                plain[k] = (T0 + dt.timedelta(hours=h), v, c)
        assert state(spark, store, schema) == plain


def test_untouched_buckets_keep_their_files(spark):
    store = new_store(spark, buckets=16)
    store.merge(frame(spark, [(k, 1, 1.0, 1) for k in range(200)]), 0)
    before = files(spark, store, 0)
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    touched = store.merge(frame(spark, [(7, 2, 2.0, 1), (9, 0, 9.0, 1)]), 1)
    after = files(spark, store, 1)
    assert 1 <= len(touched) <= 2
    assert {b for b in after if after[b] != before[b]} == set(touched)


def test_replay_changes_nothing(spark):
    store = new_store(spark, buckets=4)
    schema = frame(spark, []).schema
    store.merge(frame(spark, [(1, 1, 1.0, 1), (2, 1, 1.0, 1)]), 0)
    second = frame(spark, [(1, 5, 5.0, 1), (3, 0, 3.0, 1), (2, 0, 0.5, 1)])
    store.merge(second, 1)
    once, manifest = state(spark, store, schema), store.manifest(spark, 1)
    store.merge(second, 1)
    assert state(spark, store, schema) == once and store.manifest(spark, 1) == manifest
    assert store.versions(spark) == [0, 1]
    assert state(spark, store, schema)[2] == (T0 + dt.timedelta(hours=1), 1.0, 1)      # the late row lost


def test_old_versions_are_retired_and_empty_batches_pass(spark):
    store = new_store(spark, buckets=4)
    for version in range(5):
        store.merge(frame(spark, [(k, version, float(version), 1) for k in range(40)]), version)
    store.merge(frame(spark, []), 5)
    assert store.versions(spark) == [4, 5]
    assert not path_exists(spark, f"{store.base}/data/v=0") and not path_exists(spark, f"{store.base}/data/v=3")
    assert path_exists(spark, f"{store.base}/data/v=4")
    assert {v for _, v, _ in state(spark, store, frame(spark, []).schema).values()} == {4.0}


def test_a_cut_off_merge_is_not_seen(spark):
    store = new_store(spark, buckets=4)
    schema = frame(spark, []).schema
    store.merge(frame(spark, [(1, 1, 1.0, 1)]), 0)
    # the data of version 1 was written, its manifest was not
    frame(spark, [(1, 9, 9.0, 1)]).write.parquet(f"{store.base}/data/v=1/bucket=0")
    assert state(spark, store, schema)[1][1] == 1.0
    store.merge(frame(spark, [(1, 2, 2.0, 1)]), 1)
    assert state(spark, store, schema) == {1: (T0 + dt.timedelta(hours=2), 2.0, 1)}


def test_lookup_reads_only_the_keys_buckets(spark):
    store = new_store(spark, buckets=16)
    schema = frame(spark, []).schema
    store.merge(frame(spark, [(k, 1, float(k), 1) for k in range(100)]), 0)
    keys = spark.createDataFrame([(5,), (1000,), (None,)], "k long")
    found = store.lookup(keys, schema)
    assert sorted((r["k"], r["v"]) for r in found.collect() if r["k"] is not None) == [(5, 5.0), (1000, None)]
    assert found.count() == 3 and len(found.inputFiles()) <= 2


def test_repeated_events_pass_once(spark, tmp_path):
    rows = [(k % 7, k, 1.0, k) for k in range(50)]
    for part in (rows[:30], rows[:30], rows[20:], rows[20:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (without_repeats(stream, ["k", "c"], "ts", "2 days").writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["c"] for r in out.select("c").collect()) == list(range(50))
    assert out.agg(F.count("*")).first()[0] == 50
