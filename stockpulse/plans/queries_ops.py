"""Operations queries: call metrics over `events`, run log of a staged run.

Mapping: every event is one inference call at `ts`; `event_type` is the
request path; 'error' events are failed calls; `value` is the latency in
milliseconds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockpulse.operators import alerts, histograms
from stockpulse.operators import monitoring as mon
from stockpulse.plans.queries_quality import _LANDING_SQL
from stockpulse.plans.registry import register
from stockpulse.sources.tables import read_table

HOLD_SECONDS = 10


def calls(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("ts", F.col("event_type").alias("path"), (F.col("event_type") != "error").alias("ok"),
                     (F.col("value") / 1000.0).alias("latency_s"))


_CALLS_SQL = """calls AS (SELECT ts, event_type AS path, event_type <> 'error' AS ok, value / 1000.0 AS latency_s FROM events)"""


@register("f17_call_counters", sql=f"""WITH {_CALLS_SQL}
SELECT CAST(count_if(ok) AS BIGINT) AS success_total, CAST(count_if(NOT ok) AS BIGINT) AS failure_total,
       count(*) AS calls_total FROM calls""")
def call_counters(spark, sf_dir):
    """Inference success / failure totals."""
    return mon.call_counters(calls(spark, sf_dir))


@register("f20_failure_ratio", sql=f"""WITH {_CALLS_SQL}
SELECT CAST(count_if(NOT ok) AS BIGINT) AS failure_total, count(*) AS calls_total,
       count_if(NOT ok) / nullif(count(*), 0) AS failure_ratio,
       coalesce(count_if(NOT ok) / nullif(count(*), 0) > 0.2, false) AS alert FROM calls""")
def failure_ratio(spark, sf_dir):
    """failure ratio and the > 0.2 alert."""
    return mon.failure_ratio(calls(spark, sf_dir))


_BOUNDS = mon.LATENCY_BUCKETS + [float("inf")]
_HIST_SQL = f"""WITH {_CALLS_SQL},
hist AS ({' UNION ALL '.join(f"SELECT CAST('{b}' AS DOUBLE) AS le, CAST(count_if(latency_s <= CAST('{b}' AS DOUBLE)) AS BIGINT) AS count FROM calls" for b in _BOUNDS)})"""


@register("f18_latency_histogram", sql=_HIST_SQL + "\nSELECT le, count FROM hist")
def latency_histogram(spark, sf_dir):
    """cumulative latency histogram with the fixed bucket bounds."""
    return mon.latency_histogram(calls(spark, sf_dir))


def _quantile_sql(q):
    return f"""SELECT CAST({q} AS DOUBLE) AS quantile,
  CASE WHEN le = CAST('inf' AS DOUBLE) THEN prev_le WHEN count = coalesce(prev_count, 0) THEN le
       ELSE coalesce(prev_le, 0.0) + (le - coalesce(prev_le, 0.0)) * ({q} * total - coalesce(prev_count, 0))
            / (count - coalesce(prev_count, 0)) END AS value
FROM (SELECT *, lag(le) OVER (ORDER BY le) AS prev_le, lag(count) OVER (ORDER BY le) AS prev_count,
             max(count) OVER () AS total FROM hist) h
WHERE count >= {q} * total AND total > 0
ORDER BY le LIMIT 1"""


@register("f19_latency_quantiles", sql=_HIST_SQL + f"\nSELECT * FROM ({_quantile_sql(0.9)}) UNION ALL SELECT * FROM ({_quantile_sql(0.95)})")
def latency_quantiles(spark, sf_dir):
    """p90 / p95 latency from the histogram buckets (interpolated)."""
    h = mon.latency_histogram(calls(spark, sf_dir))
    return mon.bucket_quantile(h, 0.9).unionByName(mon.bucket_quantile(h, 0.95))


_SLIDE_SQL = f"""WITH {_CALLS_SQL},
slid AS (SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start, path, ok
         FROM calls, (SELECT unnest(range(0, 5)) AS k)),
agg AS (SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, path,
               count(*) AS calls, CAST(count_if(NOT ok) AS BIGINT) AS failures FROM slid GROUP BY 1, 2, 3)"""


@register("k3_rate_5m", sql=_SLIDE_SQL + "\nSELECT window_start, window_end, path, calls / 300.0 AS rate FROM agg")
def rate_5m(spark, sf_dir):
    """K3: calls per second per path over sliding 5-minute windows (1-minute step)."""
    return mon.rate(calls(spark, sf_dir), "path")


@register("f21_rate_by_status", sql=f"""WITH {_CALLS_SQL},
c2 AS (SELECT ts, CASE WHEN ok THEN 'success' ELSE 'failure' END AS status, ok FROM calls),
slid AS (SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start, status
         FROM c2, (SELECT unnest(range(0, 5)) AS k))
SELECT window_start + INTERVAL 5 MINUTE AS window_end, status, sum(r) AS rate FROM (
  SELECT window_start, status, count(*) / 300.0 AS r FROM slid GROUP BY 1, 2) GROUP BY 1, 2""")
def rate_by_status(spark, sf_dir):
    """sum(rate) by a label (call status)."""
    c = calls(spark, sf_dir).withColumn("status", F.when(F.col("ok"), "success").otherwise("failure"))
    return mon.rate_sum_by(mon.rate(c, "status"), "status")


@register("k4_failure_alerts", sql=_SLIDE_SQL + f""",
tot AS (SELECT path, window_end, calls, failures FROM agg),
x AS (SELECT path, window_end FROM tot WHERE failures / nullif(calls, 0) > 0.2),
-- an evaluation belongs to the run that began at the latest evaluation without one a minute before it
heads AS (SELECT a.path, a.window_end FROM x a
          WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.path = a.path AND b.window_end = a.window_end - INTERVAL 1 MINUTE)),
t AS (SELECT x.path, x.window_end, max(h.window_end) AS head FROM x JOIN heads h
      ON h.path = x.path AND h.window_end <= x.window_end GROUP BY 1, 2)
SELECT path, head AS start, max(window_end) AS "end", count(*) AS evaluations,
       CAST(epoch(max(window_end)) - epoch(head) AS BIGINT) AS held_seconds,
       epoch(max(window_end)) - epoch(head) >= {HOLD_SECONDS} AS fired
FROM t GROUP BY path, head""")
def failure_alerts(spark, sf_dir):
    """K4: failure share of a path over the sliding 5-minute window above 0.2,
    held for 10 s across 1-minute evaluations; a minute without one ends it."""
    s = mon.sliding_counts(calls(spark, sf_dir), "path")
    pred = (F.col("failures") / F.nullif(F.col("calls"), F.lit(0))) > mon.FAILURE_RATIO_LIMIT
    return mon.held_alerts(s, "window_end", pred, HOLD_SECONDS, ["path"])


@register("k3_counter_rate", sql=f"""WITH {_CALLS_SQL},
per_minute AS (SELECT path, date_trunc('minute', ts) AS minute, count(*) AS n FROM calls GROUP BY 1, 2),
counter AS (SELECT path, minute, sum(n) OVER (PARTITION BY path, CAST(minute AS DATE) ORDER BY minute) AS v FROM per_minute),
inc AS (SELECT path, minute, v, lag(v) OVER (PARTITION BY path ORDER BY minute) AS p FROM counter),
slid AS (SELECT path, minute - k * INTERVAL 1 MINUTE AS window_start,
                CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS d
         FROM inc, (SELECT unnest(range(0, 5)) AS k))
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, path, sum(d) / 300.0 AS rate FROM slid GROUP BY 1, 2, 3""")
def counter_rate(spark, sf_dir):
    """K3: rate of a call counter that restarts every midnight, sampled each
    minute with calls: resets are recognised, the first sample has no increase."""
    from pyspark.sql import Window
    per = (calls(spark, sf_dir).groupBy("path", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"))
           .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("path", F.to_date("minute")).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    counter = per.select("path", "minute", F.sum("n").over(w).alias("v"))
    return mon.counter_rate(counter, "path", "minute", "v")


_STAGES_SQL = f"""WITH {_LANDING_SQL},
typed AS (SELECT * REPLACE (TRY_CAST(quantity_consumed AS DOUBLE) AS quantity_consumed) FROM landing),
flagged AS (SELECT *, count(*) OVER (PARTITION BY transaction_id) > 1 AS again FROM typed),
ok AS (SELECT * FROM flagged WHERE NOT (transaction_id IS NULL OR sku_id IS NULL OR transaction_time IS NULL
       OR (transaction_id IS NOT NULL AND again) OR coalesce(quantity_consumed < 0, false))),
days AS (SELECT sku_id, hospital_id, CAST(transaction_time AS DATE) AS d, sum(quantity_consumed) AS q FROM ok
         WHERE quantity_consumed >= 0 GROUP BY ALL),
best AS (SELECT sku_id FROM days GROUP BY sku_id ORDER BY sum(q) DESC, sku_id LIMIT 10),
best_tx AS (SELECT sku_id FROM ok WHERE quantity_consumed >= 0 GROUP BY sku_id ORDER BY sum(quantity_consumed) DESC, sku_id LIMIT 10),
n AS (SELECT (SELECT count(*) FROM ok) AS valid, (SELECT count(*) FROM flagged) - (SELECT count(*) FROM ok) AS bad,
             (SELECT count(*) FROM ok WHERE quantity_consumed >= 0) AS clean, (SELECT count(*) FROM part) AS skus,
             (SELECT count(*) FROM days) AS days, (SELECT count(*) FROM days SEMI JOIN best USING (sku_id)) AS top_days,
             (SELECT count(*) FROM ok SEMI JOIN best_tx USING (sku_id) WHERE quantity_consumed >= 0) AS events)
SELECT job, table_name, rows, 'COMPLETE' AS state, 1::BIGINT AS runs, 0::BIGINT AS failures FROM n, LATERAL (VALUES
  ('data_validation', 'raw_zone/inventory_transactions', valid), ('data_validation', 'raw_zone/inventory_transactions_rejected', bad),
  ('data_validation', 'raw_zone/sku_master', skus), ('data_validation', 'raw_zone/inventory_transactions_valid_csv', valid),
  ('data_validation', 'raw_zone/sku_master_valid_csv', skus),
  ('data_validation', 'profiles/inventory_transactions_describe_csv', 8), ('data_validation', 'profiles/inventory_transactions_nulls_csv', 20),
  ('data_validation', 'profiles/sku_master_describe_csv', 7), ('data_validation', 'profiles/sku_master_nulls_csv', 23),
  ('clean_zone', 'clean_zone/inventory_transactions', clean), ('clean_zone', 'clean_zone/sku_master', skus),
  ('clean_zone', 'clean_zone/inventory_transactions_csv', clean), ('clean_zone', 'clean_zone/sku_master_csv', skus),
  ('daily_table', 'clean_zone/daily_sku_demand', days), ('feature_store_full', 'feature_store/sku_demand_daily_features', days),
  ('feature_store_top10', 'feature_store/sku_demand_daily_features_top_10', top_days),
  ('event_features', 'feature_store/sku_event_features', events)) t(job, table_name, rows) WHERE rows > 0"""


@register("l14_run_stages", sql=_STAGES_SQL)
def run_stages(spark, sf_dir):
    """Run all stages for both inputs
    through the run-log wrapper into a fresh shared folder; the result is the
    row count of every table and CSV written, with its job's last state and counters."""
    from stockpulse.plans.stages import run_stages as run, table_counts
    from stockpulse.session import run_folder
    log = run(spark, sf_dir, run_folder(spark, "stages"))
    rl = log.read()
    state = mon.last_state(rl).join(mon.state_counters(rl), "job").select("job", "state", "runs", "failures")
    return table_counts(log).join(state, "job")


@register("f12_logged_rule_counts", sql=f"""WITH {_LANDING_SQL},
typed AS (SELECT * REPLACE (TRY_CAST(quantity_consumed AS DOUBLE) AS quantity_consumed) FROM landing),
flagged AS (SELECT *, count(*) OVER (PARTITION BY transaction_id) > 1 AND transaction_id IS NOT NULL AS again,
                   coalesce(quantity_consumed < 0 OR isnan(quantity_consumed), false) AS low FROM typed),
n AS (SELECT count(*) AS rows, count_if(transaction_id IS NULL) AS a, count_if(transaction_time IS NULL) AS b,
             count_if(sku_id IS NULL) AS c, count_if(again) AS d, count_if(low) AS e,
             count_if(transaction_id IS NULL OR transaction_time IS NULL OR sku_id IS NULL OR again OR low) AS bad FROM flagged)
SELECT metric, CAST(value AS BIGINT) AS value FROM n, LATERAL (VALUES ('rows', rows), ('passed', rows - bad), ('rejected', bad),
  ('rule:transaction_id_not_null', a), ('rule:transaction_time_not_null', b), ('rule:sku_id_not_null', c),
  ('rule:transaction_id_unique', d), ('rule:quantity_consumed_between', e)) t(metric, value)""")
def logged_rule_counts(spark, sf_dir):
    """The validation stage run alone; its counts per outcome and per rule, observed
    while the split was written and read from the run log."""
    from stockpulse.plans.stages import run_stages as run
    from stockpulse.session import run_folder
    log = run(spark, sf_dir, run_folder(spark, "stages"), only="data_validation")
    mine = "inventory_transactions/"
    return mon.logged_counts(log.read()).where(F.col("metric").startswith(mine)).select(
        F.expr(f"substr(metric, {len(mine) + 1})").alias("metric"), "value")


@register("k3_stream_rate", sql=_SLIDE_SQL + """
SELECT window_start, window_end, path, calls, failures, calls / 300.0 AS rate FROM agg
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_rate(spark, sf_dir):
    """K3 (streaming form): the events replayed as a stream (availableNow)
    through event-time sliding windows with a 10-minute watermark, append
    mode into a Parquet sink; the result is every window the watermark has
    closed, read back."""
    from stockpulse.session import run_folder
    from stockpulse.sources.tables import stream_path
    from stockpulse.streaming.rates import start_rates
    ev = read_table(spark, sf_dir, "events")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .parquet(stream_path(spark, sf_dir, "events"))
              # watermarks need zone-aware event time; the session zone is UTC
              .select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"),
                      (F.col("event_type") != "error").alias("ok")))
    run = run_folder(spark, "stream_rate")
    q = start_rates(stream, "path", f"{run}/out", f"{run}/_checkpoint", watermark="10 minutes")
    q.awaitTermination()
    out = spark.read.parquet(f"{run}/out")
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("window_start", "window_end") else c
                        for c in out.columns])


# Every event is a pipeline run of one of four jobs, an error one that failed; a signup is a training run that
# fails above a value of 40, a click above 40 a drift finding.
COUNTERS = ["pipeline_runs_total", "pipeline_failures_total", "training_success_total", "training_failure_total",
            "drift_detected_total"]


def counted(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    kind, high = F.col("event_type"), F.col("value") > 40
    return ev.select(F.concat(F.lit("job_"), F.col("user_id") % 4).alias("job"), "ts", *[
        F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in zip(COUNTERS, (
            F.lit(True), kind == "error", (kind == "signup") & ~high, (kind == "signup") & high, (kind == "click") & high))])


_COUNTED_SQL = """counted AS (SELECT 'job_' || (user_id % 4) AS job, ts, 1 AS pipeline_runs_total,
  CAST(event_type = 'error' AS INT) AS pipeline_failures_total,
  CAST(event_type = 'signup' AND value <= 40 AS INT) AS training_success_total,
  CAST(event_type = 'signup' AND value > 40 AS INT) AS training_failure_total,
  CAST(event_type = 'click' AND value > 40 AS INT) AS drift_detected_total FROM events)"""
_ALERT_SQL = f"""WITH {_COUNTED_SQL},
per AS (SELECT job, date_trunc('minute', ts) AS ts, {', '.join(f'sum({c}) AS {c}' for c in COUNTERS)} FROM counted GROUP BY 1, 2),
grid AS (SELECT job, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM per GROUP BY job),
scrapes AS (SELECT job, ts, {', '.join(f'coalesce(sum({c}) OVER d, 0) AS {c}' for c in COUNTERS)}
            FROM grid LEFT JOIN per USING (job, ts)
            WINDOW d AS (PARTITION BY job, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
rules(alert, severity, hold) AS (VALUES {', '.join(f"('{r.alert}', '{r.severity}', {r.hold_seconds})" for r in alerts.RULES)}),
active AS (SELECT alert, severity, hold, job, ts FROM scrapes, rules WHERE CASE alert
             WHEN 'PipelineFailed' THEN pipeline_failures_total > 0 WHEN 'TrainingFailed' THEN training_failure_total > 0
             WHEN 'DataDriftDetected' THEN drift_detected_total > 0
             ELSE pipeline_failures_total / nullif(pipeline_runs_total, 0) > 0.2 END),
-- evaluations a minute apart differ from their number in order by the same time
numbered AS (SELECT *, ts - INTERVAL 1 MINUTE * row_number() OVER (PARTITION BY alert, job ORDER BY ts) AS island FROM active),
islands AS (SELECT alert, severity, hold, job, min(ts) AS s, max(ts) AS e, count(*) AS evaluations
            FROM numbered GROUP BY alert, severity, hold, job, island),
judged AS (SELECT *, epoch(e) - epoch(s) >= hold AS fired, e < (SELECT max(ts) FROM scrapes) AS closed FROM islands)"""
_ALERT_OUT = """
SELECT alert, severity, job, s AS pending_at, CASE WHEN fired THEN s + INTERVAL 1 MINUTE END AS firing_at,
       CASE WHEN closed THEN e + INTERVAL 1 MINUTE END AS resolved_at, evaluations,
       CASE WHEN closed AND fired THEN 'resolved' WHEN closed THEN 'inactive' WHEN fired THEN 'firing' ELSE 'pending' END AS state
FROM judged"""


def _zone_free(df):
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name
                       for f in df.schema.fields])


@register("k4_alert_rules", sql=_ALERT_SQL + _ALERT_OUT)
def alert_rules(spark, sf_dir):
    """K4: all four alert rules (pipeline failed, training failed, drift, failure share) over counters that
    restart at midnight, scraped every minute: pending, firing and resolved times."""
    return _zone_free(alerts.alert_history(alerts.scrapes(counted(spark, sf_dir), "job", "ts", COUNTERS)))


@register("k4_alert_rules_stream", sql=_ALERT_SQL + """,
seen AS (SELECT max(ts) AS top FROM scrapes)""" + _ALERT_OUT + ", seen WHERE e + INTERVAL 90 SECOND <= top - INTERVAL 10 MINUTE")
def alert_rules_stream(spark, sf_dir):
    """K4 (streaming form): the scrape log, one file per quarter of its time, replayed as a stream through
    session windows with a 10-minute watermark; the result is every alert the watermark has closed."""
    from stockpulse.session import run_folder
    from stockpulse.streaming.alerts import start_alerts
    run = run_folder(spark, "alerts")
    alerts.scrapes(counted(spark, sf_dir), "job", "ts", COUNTERS).write.parquet(f"{run}/scrapes")
    log = spark.read.parquet(f"{run}/scrapes")
    lo, hi = log.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    # files arrive in the order of time, as scrapes do
    for i in range(4 if lo is not None else 0):
        quarter = F.floor((F.unix_seconds("ts") - lo) * 4 / (hi - lo + 1))
        log.where(quarter == i).coalesce(1).write.mode("append").parquet(f"{run}/log")
    if lo is None:
        log.write.parquet(f"{run}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/log")
    start_alerts(stream, f"{run}/out", f"{run}/_checkpoint", watermark="10 minutes").awaitTermination()
    return _zone_free(spark.read.parquet(f"{run}/out"))


@register("f17_training_drift_counters", sql=f"""WITH {_COUNTED_SQL}
SELECT job, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)} FROM counted GROUP BY job""")
def training_drift_counters(spark, sf_dir):
    """runs, failures, training successes and failures and drift findings per job."""
    return alerts.totals(counted(spark, sf_dir), "job", COUNTERS)


def _window_quantile_sql(qs=(0.9, 0.95)):
    b = mon.LATENCY_BUCKETS
    n = len(b)
    cols = [f"b{i}" for i in range(n + 1)]
    inc = ", ".join(f"CASE WHEN lag({c}) OVER p IS NULL THEN 0 WHEN {c} >= lag({c}) OVER p THEN {c} - lag({c}) OVER p ELSE {c} END AS {c}" for c in cols)

    def interp(q):
        rank = f"({q} * CAST(b{n} AS DOUBLE))"
        cases = " ".join(
            f"WHEN b{i} >= {rank} THEN coalesce({b[i - 1] if i else 0.0}::DOUBLE + ({b[i]}::DOUBLE - {b[i - 1] if i else 0.0}::DOUBLE)"
            f" * ({rank} - {f'b{i - 1}' if i else '0'}) / nullif(b{i} - {f'b{i - 1}' if i else '0'}, 0)::DOUBLE, {b[i]}::DOUBLE)" for i in range(n))
        return (f"SELECT window_end, path, CAST({q} AS DOUBLE) AS quantile, CASE WHEN b{n} <= 0 THEN NULL {cases} ELSE {b[-1]}::DOUBLE END AS value FROM fixed")
    return f"""WITH {_CALLS_SQL},
per AS (SELECT path, date_trunc('minute', ts) AS minute,
        {', '.join(f'count_if(latency_s <= {x}) AS b{i}' for i, x in enumerate(b))}, count(*) AS b{n} FROM calls GROUP BY 1, 2),
counters AS (SELECT path, minute, {', '.join(f'sum({c}) OVER d AS {c}' for c in cols)} FROM per
             WINDOW d AS (PARTITION BY path, CAST(minute AS DATE) ORDER BY minute ROWS UNBOUNDED PRECEDING)),
inc AS (SELECT path, minute, {inc} FROM counters WINDOW p AS (PARTITION BY path ORDER BY minute)),
slid AS (SELECT minute + (5 - k) * INTERVAL 1 MINUTE AS window_end, path, {', '.join(cols)} FROM inc, (SELECT unnest(range(0, 5)) AS k)),
sums AS (SELECT window_end, coalesce(path, '*') AS path, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in cols)}
         FROM slid GROUP BY GROUPING SETS ((window_end, path), (window_end))),
fixed AS (SELECT window_end, path, b0, {', '.join(f'greatest({", ".join(cols[:i + 1])}) AS b{i}' for i in range(1, n + 1))} FROM sums)
{' UNION ALL '.join(interp(q) for q in qs)}"""


@register("f19_window_quantiles", sql=_window_quantile_sql())
def window_quantiles(spark, sf_dir):
    """p90 / p95 latency per path and over all paths in sliding 5-minute windows, from bucket counters
    that restart at midnight."""
    return histograms.window_quantiles(calls(spark, sf_dir), "path", "latency_s")
