"""Run log and metric queries (L13, L14 support, F17-F21, K3-K5).

Metrics are tables, not an in-process registry:
* `run_log`  (run_id, job, state, event_time, duration_s, inputs, outputs, schemas)
* call logs  (ts, path, ok, latency_s) - one row per request

Rates use sliding event-time windows (`window(ts, 5 min, 1 min)`), i.e. a
partial/final aggregate keyed by (window, label): no per-series ordering,
so a label holding a third of all calls is pre-aggregated on the map side.
Bucket and island computations run on those per-window aggregates, whose
size is bounded by the time span, not by the call volume.
"""

from __future__ import annotations

import time
import traceback
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
LATENCY_BUCKETS = [0.01, 0.05, 0.1, 0.3, 0.5, 1.0, 2.0, 5.0]   # seconds, plus +Inf
FAILURE_RATIO_LIMIT = 0.2
RATE_RANGE = "5 minutes"
RATE_RANGE_SECONDS = 300
EVAL_STEP = "1 minute"
EVAL_STEP_SECONDS = 60
STATES = ("START", "COMPLETE", "FAIL")

RUN_LOG_SCHEMA = ("run_id string, job string, state string, event_time timestamp, duration_s double, "
                  "inputs array<string>, outputs array<string>, schemas map<string,string>, "
                  "metrics map<string,bigint>")


# ------------------------------------------------------------------ run log

class RunLog:
    """Append-only run log table (Parquet under a shared path).
    Each state change is one appended row; nothing is read back to write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def emit(self, run_id: str, job: str, state: str, duration_s: float | None = None,
             inputs=(), outputs=(), metrics: dict[str, int] | None = None) -> None:
        if state not in STATES:
            raise ValueError(state)
        row = [(run_id, job, state, None, duration_s, list(inputs), list(outputs), self._schemas([*inputs, *outputs]),
                dict(metrics or {}))]
        df = (self.spark.createDataFrame(row, RUN_LOG_SCHEMA)
              .withColumn("event_time", F.current_timestamp()))
        df.write.mode("append").parquet(self.path)

    def _schemas(self, paths) -> dict[str, str]:
        """The schema of every input and output that is a complete Parquet table by now."""
        from stockpulse.sources.io import is_complete
        return {p: self.spark.read.parquet(p).schema.simpleString() for p in paths
                if is_complete(self.spark, p) and not p.endswith("_csv")}

    def read(self) -> DataFrame:
        return self.spark.read.schema(RUN_LOG_SCHEMA).parquet(self.path)

    def run_step(self, job: str, fn: Callable[[], object], run_id: str | None = None,
                 inputs=(), outputs=()):
        """START, run, then COMPLETE (or FAIL and re-raise), with duration. Counts that the
        step returns (name -> number) are logged with COMPLETE."""
        run_id = run_id or str(uuid.uuid4())
        self.emit(run_id, job, "START", None, inputs, outputs)
        t0 = time.time()
        try:
            out = fn()
        except Exception:
            self.emit(run_id, job, "FAIL", time.time() - t0, inputs, outputs)
            traceback.print_exc()
            raise
        self.emit(run_id, job, "COMPLETE", time.time() - t0, inputs, outputs, out if isinstance(out, dict) else None)
        return out


def logged_counts(run_log: DataFrame) -> DataFrame:
    """(run_id, job, metric, value) of every count that a step logged."""
    return (run_log.where(F.col("state") == "COMPLETE")
            .select("run_id", "job", F.explode("metrics").alias("metric", "value")))


def state_counters(run_log: DataFrame) -> DataFrame:
    """runs, completions, failures per job."""
    return run_log.groupBy("job").agg(
        F.count_if(F.col("state") == "START").alias("runs"),
        F.count_if(F.col("state") == "COMPLETE").alias("completed"),
        F.count_if(F.col("state") == "FAIL").alias("failures"))


def last_state(run_log: DataFrame) -> DataFrame:
    """K5: last state per (run, job); running = started with no end yet."""
    order = F.struct("event_time", F.when(F.col("state") == "START", 0).otherwise(1))
    g = run_log.groupBy("run_id", "job").agg(F.max_by("state", order).alias("state"),
                                            F.max("event_time").alias("event_time"))
    return g.withColumn("running", (F.col("state") == "START").cast("int"))


# ------------------------------------------------------------------ calls

def call_counters(calls: DataFrame) -> DataFrame:
    """Success and failure totals."""
    return calls.agg(F.count_if(F.col("ok")).alias("success_total"),
                     F.count_if(~F.col("ok")).alias("failure_total"),
                     F.count(F.lit(1)).alias("calls_total"))


def failure_ratio(calls: DataFrame, limit: float = FAILURE_RATIO_LIMIT) -> DataFrame:
    """failures / calls (NULL when there are no calls) and the alert."""
    c = call_counters(calls)
    ratio = F.col("failure_total") / F.nullif(F.col("calls_total"), F.lit(0))
    return c.select("failure_total", "calls_total", ratio.alias("failure_ratio"),
                    F.coalesce(ratio > limit, F.lit(False)).alias("alert"))


def latency_histogram(calls: DataFrame, buckets=LATENCY_BUCKETS, value: str = "latency_s") -> DataFrame:
    """cumulative bucket counts (le, count) including +Inf - one
    aggregate pass with a count_if per bound."""
    aggs = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(F.lit(1)).alias(f"b{len(buckets)}"))
    bounds = list(buckets) + [float("inf")]
    stack = ", ".join(f"CAST('{b}' AS DOUBLE), b{i}" for i, b in enumerate(bounds))
    return calls.agg(*aggs).selectExpr(f"stack({len(bounds)}, {stack}) AS (le, count)")


def bucket_quantile(hist: DataFrame, q: float, group: list[str] | None = None) -> DataFrame:
    """quantile from cumulative buckets by linear interpolation inside
    the bucket holding rank q * total; a rank in the +Inf bucket returns the
    largest finite bound; no observations -> NULL. Windows run per group over
    the bucket rows only (a handful per group)."""
    group = group or []
    w = Window.partitionBy(*group).orderBy("le")
    h = hist.select(*group, "le", "count",
                    F.lag("le").over(w).alias("prev_le"), F.lag("count").over(w).alias("prev_count"),
                    F.max("count").over(Window.partitionBy(*group)).alias("total"))
    rank = F.lit(q) * F.col("total")
    hit = h.where((F.col("count") >= rank) & (F.col("total") > 0))
    first_hit = hit.groupBy(*group).agg(F.min_by(F.struct(*h.columns), F.col("le")).alias("b")).select(*group, "b.*") \
        if group else hit.orderBy("le").limit(1)
    lower = F.coalesce(F.col("prev_le"), F.lit(0.0))
    below = F.coalesce(F.col("prev_count"), F.lit(0))
    interp = lower + (F.col("le") - lower) * (rank - below) / (F.col("count") - below)
    val = (F.when(F.col("le") == float("inf"), F.col("prev_le"))
           .when(F.col("count") == below, F.col("le")).otherwise(interp))
    return first_hit.select(*group, F.lit(q).alias("quantile"), val.alias("value"))


def sliding_counts(calls: DataFrame, label: str, range_=RATE_RANGE, step=EVAL_STEP) -> DataFrame:
    """Calls and failures per (sliding window, label): counted per step first
    (a window is a whole number of steps), then slid over those few rows."""
    per_step = (calls.groupBy(F.window("ts", step).alias("s"), label)
                .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"))
                .select(F.col("s.start").alias("ts"), label, "n", "bad"))
    return (per_step.groupBy(F.window("ts", range_, step).alias("w"), label)
            .agg(F.sum("n").alias("calls"), F.sum("bad").alias("failures"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label,
                    "calls", "failures"))


def rate(calls: DataFrame, label: str, range_seconds: int = RATE_RANGE_SECONDS) -> DataFrame:
    """K3: per-second rate of calls per label over sliding 5-minute windows."""
    s = sliding_counts(calls, label)
    return s.select("window_start", "window_end", label, (F.col("calls") / float(range_seconds)).alias("rate"))


def counter_increases(samples: DataFrame, label: str, ts: str, value: str) -> DataFrame:
    """K3: increase of a counter at each sample since the one before; after a
    reset (the value fell) the new value is the increase, the first sample of a label
    has none. The window holds one label's samples."""
    w = Window.partitionBy(label).orderBy(ts)
    before = F.lag(value).over(w)
    return samples.select(label, ts, F.when(F.col(value) >= before, F.col(value) - before)
                          .when(before.isNotNull(), F.col(value)).otherwise(F.lit(0)).alias("increase"))


def counter_rate(samples: DataFrame, label: str, ts: str, value: str, range_=RATE_RANGE, step=EVAL_STEP,
                 range_seconds: int = RATE_RANGE_SECONDS) -> DataFrame:
    """K3: per-second rate of a counter over sliding windows, aware of resets."""
    inc = counter_increases(samples, label, ts, value)
    return (inc.groupBy(F.window(ts, range_, step).alias("w"), label).agg(F.sum("increase").alias("increase"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label,
                    (F.col("increase") / float(range_seconds)).alias("rate")))


def rate_sum_by(rates: DataFrame, by: str) -> DataFrame:
    """sum(rate) by a label."""
    return rates.groupBy("window_end", by).agg(F.sum("rate").alias("rate"))


def held_alerts(series: DataFrame, ts: str, predicate: F.Column, hold_seconds: int,
                group: list[str], step_seconds: int = EVAL_STEP_SECONDS) -> DataFrame:
    """K4: islands of evaluations one step apart where `predicate` holds; a
    false evaluation or a missing one ends the island. An alert fires when an
    island lasts at least `hold_seconds` (from first to last true evaluation). The
    windows hold one label's evaluations."""
    w = Window.partitionBy(*group).orderBy(ts)
    x = series.select(*group, ts, F.coalesce(predicate, F.lit(False)).alias("__p")).where("__p")
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = seconds - F.lag(seconds).over(w)
    x = x.withColumn("__new", F.coalesce(gap > step_seconds * 1_000_000, F.lit(True)).cast("int"))
    t = x.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    isl = t.groupBy(*group, "__island").agg(F.min(ts).alias("start"), F.max(ts).alias("end"),
                                           F.count(F.lit(1)).alias("evaluations"))
    held = F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    return isl.select(*group, "start", "end", "evaluations", held.alias("held_seconds"),
                      (held >= hold_seconds).alias("fired")).drop("__island")
