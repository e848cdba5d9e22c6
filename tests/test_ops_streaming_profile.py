"""Run log, metrics, alerts, streaming push and drift (FIXTURES §8)."""

import datetime as dt
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockpulse.operators import monitoring as mon, profile
from stockpulse.session import scratch_path
from stockpulse.streaming.push import PushTarget, push_batch, read_online


def test_run_log_states(spark):
    log = mon.RunLog(spark, scratch_path(spark, f"test_runlog/{uuid.uuid4().hex}"))
    log.run_step("ok_step", lambda: 1, run_id="r1")
    with pytest.raises(ZeroDivisionError):
        log.run_step("bad_step", lambda: 1 / 0, run_id="r1")
    log.emit("r2", "hanging", "START")
    rl = log.read()
    c = {r["job"]: (r["runs"], r["completed"], r["failures"]) for r in mon.state_counters(rl).collect()}
    assert c == {"ok_step": (1, 1, 0), "bad_step": (1, 0, 1), "hanging": (1, 0, 0)}
    st = {r["job"]: (r["state"], r["running"]) for r in mon.last_state(rl).collect()}
    assert st == {"ok_step": ("COMPLETE", 0), "bad_step": ("FAIL", 0), "hanging": ("START", 1)}
    dur = rl.where("state = 'COMPLETE'").first()["duration_s"]
    assert dur is not None and dur >= 0


def _prom_quantile(q, bounds, counts):
    """histogram_quantile on cumulative buckets, written out."""
    total = counts[-1]
    if total == 0:
        return None
    rank = q * total
    for i, (b, c) in enumerate(zip(bounds, counts)):
        if c >= rank:
            if math.isinf(b):
                return bounds[i - 1]
            lo, below = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
            return b if c == below else lo + (b - lo) * (rank - below) / (c - below)


def test_histogram_and_quantiles(spark):
    rng = random.Random(2)
    lat = [rng.expovariate(5) for _ in range(500)] + [7.0, 9.0]
    calls = spark.createDataFrame([(x, True) for x in lat], "latency_s double, ok boolean")
    h = mon.latency_histogram(calls).orderBy("le").collect()
    bounds = [r["le"] for r in h]
    counts = [r["count"] for r in h]
    assert counts == [sum(x <= b for x in lat) for b in bounds]
    for q in (0.5, 0.9, 0.95, 0.999):
        got = mon.bucket_quantile(mon.latency_histogram(calls), q).first()["value"]
        assert abs(got - _prom_quantile(q, bounds, counts)) < 1e-12


def test_failure_ratio_boundary(spark):
    rows = [(True,)] * 8 + [(False,)] * 2          # exactly 0.2 -> no alert
    r = mon.failure_ratio(spark.createDataFrame(rows, "ok boolean")).first()
    assert r["failure_ratio"] == 0.2 and r["alert"] is False
    r0 = mon.failure_ratio(spark.createDataFrame([], "ok boolean")).first()
    assert r0["failure_ratio"] is None and r0["alert"] is False


@pytest.mark.parametrize("held,fires", [(4, False), (5, True), (6, True)])
def test_held_alerts(spark, held, fires):
    t0 = dt.datetime(2024, 1, 1)
    ts = [t0 + dt.timedelta(seconds=s) for s in range(0, held + 1)] + [t0 + dt.timedelta(seconds=100)]
    vals = [1.0] * (held + 1) + [0.0]
    s = spark.createDataFrame([("a", *x) for x in zip(ts, vals)], "path string, ts timestamp, v double")
    out = mon.held_alerts(s, "ts", F.col("v") > 0, 5, ["path"], step_seconds=1).collect()
    assert len(out) == 1 and out[0]["held_seconds"] == held and out[0]["fired"] is fires


def test_held_alerts_end_at_holes_and_keep_labels_apart(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [("a", at(0), 1.0), ("a", at(1), 1.0), ("a", at(240), 1.0), ("b", at(2), 1.0), ("b", at(3), 0.0), ("b", at(4), 1.0)]
    s = spark.createDataFrame(rows, "path string, ts timestamp, v double")
    out = sorted((r["path"], r["start"], r["held_seconds"], r["fired"])
                 for r in mon.held_alerts(s, "ts", F.col("v") > 0, 10, ["path"]).collect())
    assert out == [("a", at(0), 60, True), ("a", at(240), 0, False), ("b", at(2), 0, False), ("b", at(4), 0, False)]


def test_counter_rate_knows_resets(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("p", t0 + dt.timedelta(minutes=m), v) for m, v in ((0, 10), (1, 25), (2, 4), (3, 4))]
    s = spark.createDataFrame(rows, "path string, ts timestamp, v long")
    inc = [r["increase"] for r in mon.counter_increases(s, "path", "ts", "v").orderBy("ts").collect()]
    assert inc == [0, 15, 4, 0]
    rates = {r["window_start"]: r["rate"] for r in mon.counter_rate(s, "path", "ts", "v").collect()}
    assert rates[t0] == 19 / 300 and rates[t0 + dt.timedelta(minutes=2)] == 4 / 300


def test_streams_read_folder_tables(spark, tmp_path):
    """A table that is a folder of part files streams like a single file."""
    from stockpulse.plans import queries_features, queries_ops
    from conftest import SF_SMALL
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(queries_features.push_stream(spark, str(tmp_path))) == key(queries_features.push_stream(spark, SF_SMALL))
    assert queries_ops.stream_rate(spark, str(tmp_path)).count() > 0


def test_sliding_rate(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 30)
    calls = spark.createDataFrame([(t0, "p", True), (t0 + dt.timedelta(minutes=3), "p", False)],
                                  "ts timestamp, path string, ok boolean")
    r = {(x["window_start"], x["path"]): x["rate"] for x in mon.rate(calls, "path").collect()}
    # each call falls in 5 one-minute-step windows; the two share 2 of them
    assert len(r) == 8 and max(r.values()) == 2 / 300


def test_push_batches_idempotent(spark):
    base = scratch_path(spark, f"test_push/{uuid.uuid4().hex}")
    tgt = PushTarget(base, "k", "ts", ["v"], created="c")
    t = dt.datetime(2024, 1, 1)
    schema = "k long, ts timestamp, v double, c long"
    b0 = spark.createDataFrame([(1, t, 1.0, 1), (2, t, 2.0, 1)], schema)
    b1 = spark.createDataFrame([(1, t + dt.timedelta(hours=1), 3.0, 1), (2, t - dt.timedelta(days=1), 9.0, 5),
                                (2, t, 4.0, 2)], schema)
    fn = push_batch(tgt)
    fn(b0, 0)
    fn(b1, 1)
    fn(b1, 1)                                       # replay of the same batch
    latest = {r["k"]: r["v"] for r in read_online(spark, tgt).collect()}
    assert latest == {1: 3.0, 2: 4.0}               # late row ignored, later created wins
    assert spark.read.parquet(tgt.offline).count() == 5   # replay overwrote its own batch


def test_drift_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, 700).round(2)
    b = rng.normal(0.3, 1.2, 500).round(2)
    ref = spark.createDataFrame([(float(x), "x" if x > 0 else "y") for x in a], "v double, c string")
    cur = spark.createDataFrame([(float(x), "x" if x > 0.5 else "y") for x in b], "v double, c string")
    rep = {r["column_name"]: r for r in profile.drift_report(ref, cur).collect()}
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    w1 = float(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)))
    assert abs(rep["v"]["drift_score"] - w1 / np.std(a)) < 1e-9
    assert abs(rep["v"]["ks_statistic"] - float(np.max(np.abs(fa - fb)))) < 1e-12
    p = np.array([(a > 0).mean(), (a <= 0).mean()])
    q = np.array([(b > 0.5).mean(), (b <= 0.5).mean()])
    m = (p + q) / 2
    js = math.sqrt((np.sum(p * np.log(p / m)) + np.sum(q * np.log(q / m))) / 2)
    assert abs(rep["c"]["drift_score"] - js) < 1e-12
    assert rep["v"]["drift_share"] == sum(r["drifted"] for r in rep.values()) / 2


def test_describe_and_quality(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, None), (None, "b"), (2.0, "a")], "x double, s string")
    d = {r["column_name"]: r for r in profile.describe(df, quartiles=True).collect()}
    assert d["s"]["top"] == "a" and d["s"]["freq"] == 3 and d["s"]["unique"] == 2
    assert d["x"]["count"] == 4 and abs(d["x"]["mean"] - 1.75) < 1e-12 and d["x"]["q50"] == 2.0
    q = profile.quality_summary(df).first()
    assert (q["rows"], q["columns"], q["missing_cells"], q["duplicated_rows"]) == (5, 2, 2, 1)


def test_streaming_rates_equal_batch_for_closed_windows(spark, tmp_path):
    from stockpulse.streaming.rates import start_rates
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(9)
    rows = [(t0 + dt.timedelta(seconds=rng.randint(0, 3 * 3600)), rng.choice(["a", "b"]), rng.random() > 0.2)
            for _ in range(400)]
    src = tmp_path / "calls"
    # six time-ordered files (one per 30 minutes) -> six micro-batches; no row
    # is older than the watermark when it arrives, so nothing is dropped late
    import time
    for i in range(6):
        part = [r for r in rows if (r[0] - t0).total_seconds() // 1800 == i]
        (spark.createDataFrame(part, "ts timestamp, path string, ok boolean").coalesce(1)
         .write.parquet(str(src / f"p{i}")))
        time.sleep(1.1)                               # distinct modification times
    schema = "ts timestamp, path string, ok boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(str(src))
    q = start_rates(stream, "path", str(tmp_path / "out"), str(tmp_path / "ckpt"), watermark="10 minutes")
    q.awaitTermination()
    got = {(r["window_start"], r["path"]): (r["calls"], r["failures"])
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = mon.sliding_counts(spark.createDataFrame(rows, schema), "path").collect()
    want = {(r["window_start"], r["path"]): (r["calls"], r["failures"]) for r in batch}
    assert got                                        # closed windows were emitted
    for k, v in got.items():                          # each emitted window is final and exact
        assert want[k] == v
    last = max(r[0] for r in rows)
    missing = [k for k in want if k not in got]
    # only windows still open under the watermark (end > max event time - 10 min) are pending
    assert all(k[0] + dt.timedelta(minutes=5) > last - dt.timedelta(minutes=10) for k in missing)
