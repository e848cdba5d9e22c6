"""Alert rules (batch and stream) and windowed quantiles against plain versions."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from stockpulse.operators import alerts, histograms

T0 = dt.datetime(2024, 1, 1)
SCRAPE = ("job string, ts timestamp, pipeline_runs_total long, pipeline_failures_total long, "
          "training_failure_total long, drift_detected_total long")


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def random_scrapes(seed, minutes=240):
    rnd, rows = random.Random(seed), []
    for job in ("a", "b"):
        runs = fails = train = drift = 0
        for m in range(minutes):
            if rnd.random() < 0.05:
                runs = fails = train = drift = 0          # the process restarted
            runs += rnd.randint(0, 3)
            fails += rnd.random() < 0.1
            train += rnd.random() < 0.03
            drift += rnd.random() < 0.03
            if rnd.random() > 0.05:                        # some scrapes are missing
                rows.append((job, at(m), runs, fails, train, drift))
    return rows


def plain_alerts(rows):
    """Walk the evaluations one by one."""
    top = max(r[1] for r in rows)
    out = []
    checks = [("PipelineFailed", "critical", 5, lambda r: r[3] > 0), ("TrainingFailed", "critical", 5, lambda r: r[4] > 0),
              ("DataDriftDetected", "warning", 5, lambda r: r[5] > 0),
              ("PipelineHighFailureRate", "warning", 10, lambda r: r[2] > 0 and r[3] / r[2] > 0.2)]
    for name, severity, hold, check in checks:
        for job in sorted({r[0] for r in rows}):
            run = []

            def close():
                if run:
                    fired = (run[-1] - run[0]).total_seconds() >= hold
                    closed = run[-1] < top
                    state = ("resolved" if closed else "firing") if fired else ("inactive" if closed else "pending")
                    out.append((name, severity, job, run[0], run[0] + dt.timedelta(minutes=1) if fired else None,
                                run[-1] + dt.timedelta(minutes=1) if closed else None, len(run), state))
                run.clear()
            for r in sorted(x for x in rows if x[0] == job):
                if run and (not check(r) or (r[1] - run[-1]).total_seconds() > 60):
                    close()
                if check(r):
                    run.append(r[1])
            close()
    return sorted(out, key=str)


def test_alert_history_equals_a_plain_walk(spark):
    rows = random_scrapes(1)
    got = alerts.alert_history(spark.createDataFrame(rows, SCRAPE))
    want = plain_alerts(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {"resolved", "inactive"} <= {r[-1] for r in want}


def test_alert_stream_gives_the_closed_alerts(spark, tmp_path):
    from stockpulse.streaming.alerts import start_alerts
    rows = random_scrapes(2)
    for part in range(4):                                   # four micro-batches in the order of time
        mine = [r for r in rows if part * 60 <= (r[1] - T0).total_seconds() / 60 < part * 60 + 60]
        spark.createDataFrame(mine, SCRAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCRAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    start_alerts(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    top = max(r[1] for r in rows)
    closed = [a for a in plain_alerts(rows) if a[5] and a[5] + dt.timedelta(seconds=30) <= top - dt.timedelta(minutes=10)]
    assert got == closed and got


def test_scrapes_restart_and_fill_the_grid(spark):
    calls = [("j", at(0.5), 1), ("j", at(0.9), 1), ("j", at(3), 1), ("j", at(24 * 60 + 1), 1)]
    got = alerts.scrapes(spark.createDataFrame(calls, "job string, ts timestamp, runs long"), "job", "ts", ["runs"]).collect()
    seen = {r["ts"]: r["runs"] for r in got}
    assert len(got) == 24 * 60 + 2
    assert [seen[at(m)] for m in (0, 1, 3, 1439, 1440, 1441)] == [2, 2, 3, 3, 0, 1]


def plain_quantile(q, bounds, counts):
    total = counts[-1]
    if total <= 0:
        return None
    for i, b in enumerate(bounds):
        if counts[i] >= q * total:
            low, below = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0)
            return b if counts[i] == below else low + (b - low) * (q * total - below) / (counts[i] - below)
    return bounds[-1]


def test_window_quantiles_equal_a_plain_version(spark):
    rnd = random.Random(4)
    bounds = [0.1, 0.5, 1.0]
    rows = [(at(rnd.randint(24 * 60 - 30, 24 * 60 + 30)) + dt.timedelta(seconds=rnd.randint(0, 59)), rnd.choice("pq"),
             rnd.choice([0.05, 0.3, 0.7, 3.0])) for _ in range(200)]
    got = {(r["window_end"], r["path"], r["quantile"]): r["value"] for r in
           histograms.window_quantiles(spark.createDataFrame(rows, "ts timestamp, path string, v double"), "path", "v",
                                       (0.5, 0.9), bounds).collect()}
    inc = defaultdict(list)                                 # (path, minute) -> increases
    for path in "pq":
        before, total, day = None, [0] * 4, None
        for minute in sorted({r[0].replace(second=0) for r in rows if r[1] == path}):
            if minute.date() != day:
                total, day = [0] * 4, minute.date()
            here = [r[2] for r in rows if r[1] == path and r[0].replace(second=0) == minute]
            total = [t + sum(x <= b for x in here) for t, b in zip(total, bounds + [float("inf")])]
            inc[path, minute] = [0] * 4 if before is None else [v - p if v >= p else v for v, p in zip(total, before)]
            before = total
    want = {}
    for path in ("p", "q", "*"):
        mine = {k: v for k, v in inc.items() if path in ("*", k[0])}
        for end in {m + dt.timedelta(minutes=k) for _, m in mine for k in range(1, 6)}:
            sums = [sum(v[i] for (_, m), v in mine.items() if end - dt.timedelta(minutes=5) <= m < end) for i in range(4)]
            sums = [max(sums[:i + 1]) for i in range(4)]
            for q in (0.5, 0.9):
                want[end, path, q] = plain_quantile(q, bounds, sums)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v or abs(got[k] - v) < 1e-12


def test_monotone_repair(spark):
    df = spark.createDataFrame([([1, 3, 2, 5],)], "b array<long>")
    assert df.select(histograms.monotone(F.col("b"), 4).alias("b")).first()["b"] == [1, 3, 3, 5]
