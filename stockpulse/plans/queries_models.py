"""Model-side queries over the top-10 feature table: split, folds, gates,
back-test metrics, registry tables, intervals and the roll-forward forecast.

Metrics and intervals are computed over a deterministic prediction column
(the naive forecast `lag_qty_1d`, or `avg_qty_7d` for forecast days) so the
SQL twin can check the arithmetic; fitted-model queries are in
`queries_ml` (row checks only).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from stockpulse.functions.calendar import sql_calendar
from stockpulse.functions.parsing import parse_key_list
from stockpulse.operators import demand, evaluation as ev, forecast as fc
from stockpulse.plans.queries_demand import _DAILY_SQL, _TOP_SQL, FEATURE_SELECT_SQL
from stockpulse.plans.registry import register
from stockpulse.session import delete_at_end, scratch_path
from stockpulse.sources import io
from stockpulse.sources.tables import TX_SQL, input_state, transactions

SERIES = ["hospital_id", "sku_id"]
AS_OF = "2002-01-01 00:00:00"
SKU_LIST = "Brand#13, Brand#21,,Brand#99"


FACT_TABLES = ("lineitem", "part", "supplier", "nation")


def top_features(spark, sf_dir):
    """The feature table (top 10), built by the first query of an application that
    needs it and read by the others, as training and forecasts read the stored
    table; other or changed inputs have a table of their own."""
    key = hashlib.sha256(f"{sf_dir}|{input_state(spark, sf_dir, FACT_TABLES)}".encode()).hexdigest()[:24]
    path = scratch_path(spark, f"features/{spark.sparkContext.applicationId}/{key}")
    delete_at_end(spark, path)
    return io.kept_table(spark, path, lambda: demand.feature_table_top(transactions(spark, sf_dir)))


_FEATS = f"WITH {TX_SQL}, {_DAILY_SQL}, {_TOP_SQL},\nfeats AS ({FEATURE_SELECT_SQL} FROM daily WHERE sku_id IN (SELECT sku_id FROM top))"
_POS = f"""{_FEATS},
pos AS (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY ds, hospital_id) - 1 AS pos,
               count(*) OVER (PARTITION BY sku_id) AS n FROM feats),
split AS (SELECT *, pos < floor(CAST(0.8 AS DOUBLE) * n) AS is_train FROM pos)"""


def _split(spark, sf_dir):
    return ev.chrono_split(top_features(spark, sf_dir), "sku_id", "ds", "hospital_id")


@register("g12_chrono_split", sql=_POS + "\nSELECT sku_id, ds, hospital_id, pos, n, is_train FROM split")
def chrono_split(spark, sf_dir):
    """Chronological 80/20 split per SKU (ties on ds by hospital)."""
    return _split(spark, sf_dir).select("sku_id", "ds", "hospital_id", F.col("pos").cast("bigint").alias("pos"),
                                        "n", "is_train")


@register("g13_time_folds", sql=_POS + """,
f AS (SELECT s.*, fold, n - (2 - fold) * (n // 3) AS train_end, n // 3 AS ts
      FROM split s, (SELECT unnest([0, 1]) AS fold))
SELECT sku_id, ds, hospital_id, fold, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS role
FROM f WHERE pos < train_end + ts""")
def time_folds(spark, sf_dir):
    """Two expanding time-series folds per SKU."""
    f = ev.time_folds(top_features(spark, sf_dir), "sku_id", "ds", "hospital_id")
    return f.select("sku_id", "ds", "hospital_id", "fold", "role")


_MAPE_SQL = """avg(CASE WHEN abs(qty_1d) < 1e-8 THEN (CASE WHEN abs(lag_qty_1d) < 1e-8 THEN 0.0 ELSE 100.0 END)
                    ELSE abs(qty_1d - lag_qty_1d) / abs(qty_1d) * 100.0 END)"""


@register("f7_backtest_metrics", sql=_POS + f"""
SELECT sku_id, round({_MAPE_SQL}, 9) AS mape, avg(abs(qty_1d - lag_qty_1d)) AS mae,
       sqrt(avg((qty_1d - lag_qty_1d) * (qty_1d - lag_qty_1d))) AS rmse, count(*) AS n_test
FROM split WHERE NOT is_train GROUP BY sku_id""")
def backtest_metrics(spark, sf_dir):
    """F7-F9, J19, L5 arithmetic: MAPE/MAE/RMSE of the naive forecast on the
    last 20 % of each SKU."""
    test = _split(spark, sf_dir).where(~F.col("is_train"))
    m = ev.regression_metrics(test, ["sku_id"], "qty_1d", "lag_qty_1d")
    return m.withColumn("mape", F.round("mape", 9))


@register("d10_history_gates", sql=_POS + """
SELECT sku_id, count(*) AS n_rows, CAST(count_if(is_train) AS BIGINT) AS n_train, count(*) >= 90 AS can_train,
       count_if(is_train) > 100 AS can_tune, count(*) >= 30 AS can_forecast
FROM split GROUP BY sku_id""")
def history_gates(spark, sf_dir):
    """History gates per SKU."""
    return ev.history_gates(_split(spark, sf_dir), "sku_id")


@register("d9_key_selection", sql=f"""WITH {TX_SQL}
SELECT DISTINCT sku_id FROM transactions
WHERE sku_id IN ('Brand#13', 'Brand#21', 'Brand#99')""")
def key_selection(spark, sf_dir):
    """Configured key list (text, blanks dropped) intersected
    with the available keys; an empty intersection would mean all keys."""
    avail = transactions(spark, sf_dir).select("sku_id").distinct()
    wanted = spark.range(1).select(F.explode(parse_key_list(F.lit(SKU_LIST), "string")).alias("sku_id"))
    return ev.select_keys(avail, "sku_id", wanted)


def _runs(feats):
    """Training runs: every month end at which an SKU has >= 90 feature rows."""
    per_month = feats.groupBy("sku_id", F.last_day("ds").alias("month_end")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("sku_id").orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    runs = per_month.withColumn("cum", F.sum("n").over(w)).where(F.col("cum") >= ev.MIN_TRAIN_ROWS)
    return runs.select("sku_id", F.col("month_end").cast("timestamp_ntz").alias("run_ts"),
                       F.concat_ws("-", "sku_id", F.date_format("month_end", "yyyyMM")).alias("run_id"))


def _versions(spark, sf_dir, feats=None):
    feats = top_features(spark, sf_dir) if feats is None else feats
    return ev.register_versions(_runs(feats), "sku_id", "run_ts", "run_id")


_RUNS_SQL = _FEATS + """,
pm AS (SELECT sku_id, last_day(ds) AS month_end, count(*) AS n FROM feats GROUP BY 1, 2),
runs AS (SELECT sku_id, CAST(month_end AS TIMESTAMP) AS run_ts, sku_id || '-' || strftime(month_end, '%Y%m') AS run_id
         FROM (SELECT *, sum(n) OVER (PARTITION BY sku_id ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM pm)
         WHERE cum >= 90),
v AS (SELECT 'sku_forecast_model_' || sku_id AS model_name,
             row_number() OVER (PARTITION BY sku_id ORDER BY run_ts, run_id) AS vn,
             count(*) OVER (PARTITION BY sku_id) AS vmax, run_id,
             CAST(epoch_us(run_ts) / 1000 AS BIGINT) AS last_updated_ms FROM runs),
versions AS (SELECT model_name, CAST(vn AS VARCHAR) AS version,
                    CASE WHEN vn = vmax THEN 'Production' ELSE 'Archived' END AS stage, run_id, last_updated_ms FROM v)"""


@register("l6_model_versions", sql=_RUNS_SQL + "\nSELECT * FROM versions")
def model_versions(spark, sf_dir):
    """Monthly retraining runs registered as versions; newest is
    Production, the rest Archived."""
    return _versions(spark, sf_dir)


@register("l7_resolve_production", sql=_RUNS_SQL + """
SELECT model_name, arg_max(version, CAST(version AS INTEGER)) AS version, arg_max(stage, CAST(version AS INTEGER)) AS stage,
       arg_max(run_id, CAST(version AS INTEGER)) AS run_id, arg_max(last_updated_ms, CAST(version AS INTEGER)) AS last_updated_ms
FROM versions WHERE stage = 'Production' GROUP BY model_name""")
def resolve_production(spark, sf_dir):
    """Model to serve in stage Production."""
    return ev.resolve_model(_versions(spark, sf_dir), "Production")


@register("h5_latest_version", sql=_RUNS_SQL + """
SELECT model_name, arg_max(version, CAST(version AS INTEGER)) AS version, arg_max(stage, CAST(version AS INTEGER)) AS stage,
       arg_max(run_id, CAST(version AS INTEGER)) AS run_id, arg_max(last_updated_ms, CAST(version AS INTEGER)) AS last_updated_ms
FROM versions GROUP BY model_name""")
def latest_version(spark, sf_dir):
    """H5: highest version by numeric order ('10' > '9')."""
    return ev.resolve_model(_versions(spark, sf_dir))


@register("f14_model_exporter", sql=_RUNS_SQL + f"""
SELECT model_name, max(CAST(version AS INTEGER)) AS latest_version, max(last_updated_ms) / 1000.0 AS last_updated_s,
       epoch_us(TIMESTAMP '{AS_OF}') / 1e6 - max(last_updated_ms) / 1000.0 AS age_seconds
FROM versions GROUP BY model_name""")
def exporter(spark, sf_dir):
    """Per model latest version, update time, age."""
    return ev.exporter_view(_versions(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


def _run_metrics(spark, sf_dir, feats=None):
    """Per run, the naive forecast's MAPE over the run's month."""
    feats = top_features(spark, sf_dir) if feats is None else feats
    runs = _runs(feats)
    m = ev.regression_metrics(feats.withColumn("run_ts", F.last_day("ds").cast("timestamp_ntz")),
                              ["sku_id", "run_ts"], "qty_1d", "lag_qty_1d")
    return (m.join(runs, ["sku_id", "run_ts"])
            .select("run_id", "sku_id", "run_ts", F.lit("metric").alias("kind"), F.lit("mape").alias("key"),
                    F.round("mape", 9).alias("value")))


_RUN_METRICS_SQL = _RUNS_SQL + f""",
mm AS (SELECT sku_id, CAST(last_day(ds) AS TIMESTAMP) AS run_ts,
              {_MAPE_SQL.replace('avg(', 'avg(', 1)} AS mape FROM feats GROUP BY 1, 2),
run_metrics AS (SELECT r.run_id, r.sku_id, r.run_ts, 'metric' AS kind, 'mape' AS key, round(mm.mape, 9) AS value
                FROM mm JOIN runs r ON mm.sku_id = r.sku_id AND mm.run_ts = r.run_ts)"""


@register("b20_run_metrics", sql=_RUN_METRICS_SQL + "\nSELECT * FROM run_metrics")
def run_metrics(spark, sf_dir):
    """Run metrics table (run, sku, kind, key, value)."""
    return _run_metrics(spark, sf_dir)


@register("f22_latest_mape", sql=_RUN_METRICS_SQL + """
SELECT sku_id, arg_max(value, run_ts) AS mape, max(run_ts) AS run_ts FROM run_metrics GROUP BY sku_id""")
def latest_mape(spark, sf_dir):
    """latest recorded MAPE per SKU."""
    rm = _run_metrics(spark, sf_dir)
    return rm.groupBy("sku_id").agg(F.max_by("value", "run_ts").alias("mape"), F.max("run_ts").alias("run_ts"))


@register("e7_interval_latest", sql=_POS + f""",
m AS (SELECT sku_id, {_MAPE_SQL} AS mape FROM split WHERE NOT is_train AND n >= 90 GROUP BY sku_id),
latest AS (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY hospital_id, sku_id ORDER BY ds DESC) = 1)
SELECT l.hospital_id, l.sku_id, l.ds, l.avg_qty_7d AS prediction, round(coalesce(m.mape, 20.0), 9) AS mape_used,
       round(l.avg_qty_7d - 1.96 * (coalesce(m.mape, 20.0) / 100.0) * abs(l.avg_qty_7d), 6) AS lower,
       round(l.avg_qty_7d + 1.96 * (coalesce(m.mape, 20.0) / 100.0) * abs(l.avg_qty_7d), 6) AS upper
FROM latest l LEFT JOIN m ON l.sku_id = m.sku_id""")
def interval_latest(spark, sf_dir):
    """Latest row of every series scored (avg_qty_7d
    as the prediction) with a MAPE interval; SKUs below the training gate
    (90 rows) have no recorded MAPE and fall back to 20."""
    sp = _split(spark, sf_dir)
    trained = sp.where(~F.col("is_train") & (F.col("n") >= ev.MIN_TRAIN_ROWS))
    m = ev.regression_metrics(trained, ["sku_id"], "qty_1d", "lag_qty_1d").select("sku_id", "mape")
    from pyspark.sql import Window
    w = Window.partitionBy(*SERIES).orderBy(F.col("ds").desc())
    latest = sp.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    j = latest.select("hospital_id", "sku_id", "ds", F.col("avg_qty_7d").alias("prediction")).join(m, "sku_id", "left")
    out = ev.with_interval(j, "prediction", "mape")
    return out.select("hospital_id", "sku_id", "ds", "prediction", F.round("mape_used", 9).alias("mape_used"),
                      F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


# ----------------------------------------------------------- roll-forward

def _rf_sql(horizon=7):
    cal = sql_calendar("ds", "forecast")
    return "WITH RECURSIVE " + _FEATS[len("WITH "):] + f""",
tail AS (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY hospital_id, sku_id ORDER BY ds DESC) <= 35),
h AS (SELECT hospital_id, sku_id, max(ds) AS last_ds, list(qty_1d ORDER BY ds) AS q, list(rev_1d ORDER BY ds) AS r
      FROM tail GROUP BY 1, 2 HAVING count(*) >= 30),
rec AS (
  SELECT hospital_id, sku_id, last_ds, len(q) AS n, 0 AS i, q, r FROM h
  UNION ALL
  SELECT hospital_id, sku_id, last_ds, n, i + 1,
         list_append(q, list_reduce(q[-7:], lambda a, x: a + x, 0.0) / 7.0),
         list_append(r, list_reduce(r[-7:], lambda a, x: a + x, 0.0) / 7.0)
  FROM rec WHERE i < {horizon}),
ext AS (SELECT * FROM rec WHERE i = {horizon}),
steps AS (SELECT e.*, s AS step, n + s - 1 AS e_idx, CAST(last_ds + s * INTERVAL 1 DAY AS DATE) AS ds
          FROM ext e, (SELECT unnest(range(1, {horizon} + 1)) AS s)),
w AS (SELECT *, list_reduce(q[greatest(e_idx - 6, 1):e_idx], lambda a, x: a + x, 0.0) AS q7,
               list_reduce(q[greatest(e_idx - 27, 1):e_idx], lambda a, x: a + x, 0.0) AS q28,
               list_reduce(r[greatest(e_idx - 6, 1):e_idx], lambda a, x: a + x, 0.0) AS r7,
               list_reduce(r[greatest(e_idx - 27, 1):e_idx], lambda a, x: a + x, 0.0) AS r28 FROM steps)
SELECT hospital_id, sku_id, CAST(step AS INTEGER) AS step, ds, {cal},
  q[e_idx] AS lag_qty_1d, CASE WHEN e_idx >= 7 THEN q[e_idx - 6] ELSE q[e_idx] END AS lag_qty_7d,
  q7 AS qty_7d, q28 AS qty_28d, q7 / 7.0 AS avg_qty_7d, q28 / 28.0 AS avg_qty_28d,
  r7 AS rev_7d, r28 AS rev_28d, r7 / 7.0 AS avg_rev_7d, r28 / 28.0 AS avg_rev_28d
FROM w"""


def _roll(spark, sf_dir, horizon=7):
    return fc.roll_forward(top_features(spark, sf_dir), SERIES, horizon)


@register("g17_roll_forward", sql=_rf_sql())
def roll_forward(spark, sf_dir):
    """7-day roll-forward features for every series."""
    return _roll(spark, sf_dir)


@register("j18_forecast_rounded", sql=f"""WITH rf AS ({_rf_sql()}),
p AS (SELECT hospital_id, sku_id, step, ds, CAST(round_even(avg_qty_7d, 0) AS INTEGER) AS predicted_qty FROM rf)
SELECT *, first_value(predicted_qty) OVER (PARTITION BY hospital_id, sku_id ORDER BY step) AS first_qty,
       avg(predicted_qty) OVER (PARTITION BY hospital_id, sku_id) AS mean_predicted
FROM p""")
def forecast_rounded(spark, sf_dir):
    """J18 / F10 / L12 basis: forecast quantity rounded half-to-even, the
    first day's value (interval width basis) and the horizon mean."""
    from pyspark.sql import Window
    rf = _roll(spark, sf_dir)
    p = rf.select(*SERIES, "step", "ds", fc.round_prediction(F.col("avg_qty_7d")).alias("predicted_qty"))
    w = Window.partitionBy(*SERIES).orderBy("step")
    return p.select("*", F.first("predicted_qty").over(w).alias("first_qty"),
                    F.avg("predicted_qty").over(Window.partitionBy(*SERIES)).alias("mean_predicted"))


@register("f13_latest_date", sql=_FEATS + "\nSELECT hospital_id, sku_id, max(ds) AS last_ds, count(*) AS n_rows FROM feats GROUP BY 1, 2")
def latest_date(spark, sf_dir):
    """latest date and row count per series."""
    return top_features(spark, sf_dir).groupBy(*SERIES).agg(F.max("ds").alias("last_ds"),
                                                             F.count(F.lit(1)).alias("n_rows"))


@register("h8_last_30_days", sql=_FEATS + """,
mx AS (SELECT hospital_id, sku_id, max(ds) AS mds FROM feats GROUP BY 1, 2)
SELECT f.hospital_id, f.sku_id, f.ds, f.qty_1d FROM feats f JOIN mx USING (hospital_id, sku_id)
WHERE f.ds > mx.mds - INTERVAL 30 DAY""")
def last_30_days(spark, sf_dir):
    """H8: the last 30 calendar days of history per series."""
    f = top_features(spark, sf_dir)
    mx = f.groupBy(*SERIES).agg(F.max("ds").alias("__mds"))
    return (f.join(mx, SERIES).where(F.col("ds") > F.date_sub("__mds", 30))
            .select("hospital_id", "sku_id", "ds", "qty_1d"))


@register("e8_sku_model_overview", sql=_RUN_METRICS_SQL + """,
prod AS (SELECT model_name, arg_max(version, CAST(version AS INTEGER)) AS version,
                max(last_updated_ms) AS last_updated_ms FROM versions WHERE stage = 'Production' GROUP BY model_name),
lm AS (SELECT sku_id, arg_max(value, run_ts) AS mape FROM run_metrics GROUP BY sku_id),
skus AS (SELECT DISTINCT p_brand AS sku_id FROM part)
SELECT s.sku_id, p.version IS NOT NULL AS model_available, p.version,
       round(lm.mape, 2) AS mape, make_timestamp(p.last_updated_ms * 1000) AS last_trained
FROM skus s LEFT JOIN prod p ON p.model_name = 'sku_forecast_model_' || s.sku_id
LEFT JOIN lm ON lm.sku_id = s.sku_id""")
def sku_model_overview(spark, sf_dir):
    """Every SKU with model availability, production version,
    latest MAPE (two decimals) and last training time."""
    from stockpulse.sources.tables import read_table
    skus = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("sku_id")).distinct()
    feats = top_features(spark, sf_dir)              # one materialised daily table for both
    prod = ev.resolve_model(_versions(spark, sf_dir, feats), "Production").select(
        "model_name", "version", "last_updated_ms")
    lm = _run_metrics(spark, sf_dir, feats).groupBy("sku_id").agg(F.max_by("value", "run_ts").alias("mape"))
    j = (skus.withColumn("model_name", ev.model_name(F.col("sku_id")))
         .join(prod, "model_name", "left").join(lm, "sku_id", "left"))
    return j.select("sku_id", F.col("version").isNotNull().alias("model_available"), "version",
                    F.round("mape", 2).alias("mape"),
                    F.timestamp_micros(F.col("last_updated_ms") * 1000).cast("timestamp_ntz").alias("last_trained"))


@register("b12_forecast_append_roundtrip", sql=f"""WITH rf AS ({_rf_sql()})
SELECT sku_id, ds AS date, CAST(round_even(avg_qty_7d, 0) AS INTEGER) AS predicted_qty,
       'Day ' || CAST(step AS VARCHAR) AS day_label, true AS has_created_at
FROM rf""")
def forecast_append(spark, sf_dir):
    """Forecast rows (roll-forward, rounded) appended to a
    forecast_results table with a default created_at, read back; each row
    also carries its horizon label and a JSON record."""
    from stockpulse.session import run_folder
    from stockpulse.sources import io
    rf = _roll(spark, sf_dir)
    rows = rf.select("sku_id", F.col("ds").alias("date"),
                     fc.round_prediction(F.col("avg_qty_7d")).alias("predicted_qty"),
                     F.concat(F.lit("Day "), F.col("step").cast("string")).alias("day_label"))
    path = run_folder(spark, "roundtrip/forecast_results")
    io.append_with_created_at(rows, path)
    back = spark.read.parquet(path)
    return back.select("sku_id", "date", "predicted_qty", "day_label",
                       F.col("created_at").isNotNull().alias("has_created_at"))


@register("j28_forecast_records", sql=f"""WITH rf AS ({_rf_sql()})
SELECT json_object('sku_id', sku_id, 'hospital_id', hospital_id, 'ds', CAST(ds AS VARCHAR),
                   'step', step, 'avg_qty_7d', avg_qty_7d)::VARCHAR AS record FROM rf""")
def forecast_records(spark, sf_dir):
    """Forecast rows as JSON records (one per series and day)."""
    rf = _roll(spark, sf_dir)
    return rf.select(F.to_json(F.struct("sku_id", "hospital_id", F.col("ds").cast("string").alias("ds"),
                                        "step", "avg_qty_7d")).alias("record"))
