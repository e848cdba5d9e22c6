"""Fitted-model queries: training, random search, batch scoring with
per-row errors, latest-row scoring with intervals, multi-day forecast, and the files and
registry entries of a training run.

The trees have no SQL twin, so the registered columns are what does not depend on
them (keys, row counts, errors, dates, the order of the bounds) and a bound on the error: a
model has to beat the forecast "as yesterday" (`beats_naive`). The `_values`
queries return the predictions themselves and are checked on rows. `l3` always fits and
writes the model to the store; the others read it and fit only where it is
missing. The store's key holds the input files, the feature version and the
parameters.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockpulse.operators import demand, evaluation as ev, forecast as fc, models as M
from stockpulse.operators.models import Fitted, TreeParams
from stockpulse.plans.queries_models import _POS, FACT_TABLES, top_features
from stockpulse.plans.registry import register
from stockpulse.session import run_folder, scratch_path
from stockpulse.sources import io
from stockpulse.sources.tables import input_state, transactions

SERIES = ["hospital_id", "sku_id"]


def store_path(spark, sf_dir: str, params: TreeParams, name: str) -> str:
    """Folder of a model table for exactly these inputs and parameters."""
    parts = [str(sorted(asdict(params).items())), f"features {M.FEATURE_VERSION}", name,
             input_state(spark, sf_dir, FACT_TABLES)]
    return scratch_path(spark, f"models/{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:24]}")


def fitted(spark, sf_dir: str, params: TreeParams = TreeParams(), refit: bool = False, tune: bool = False) -> Fitted:
    path = store_path(spark, sf_dir, params, "tuned" if tune else "top")
    if refit or not M.is_saved(spark, path):
        M.train(top_features(spark, sf_dir), params, tune).save(path)
    return M.load(spark, path)


_COUNTS = _POS + """,
counts AS (SELECT sku_id, count(*) AS n_rows, CAST(count_if(is_train) AS BIGINT) AS n_train FROM split GROUP BY sku_id)"""


@register("l3_train_per_sku", sql=_COUNTS + """
SELECT sku_id, n_train, n_rows - n_train AS n_test, true AS fitted, true AS evaluated, true AS beats_naive, CAST(NULL AS VARCHAR) AS error
FROM counts WHERE n_rows >= 90""")
def train_per_sku(spark, sf_dir):
    """Boosted trees over the rows of all top SKUs, evaluated per SKU on its last
    20 %, where they have to beat the value of the day before. Always fits."""
    return fitted(spark, sf_dir, refit=True).skus.select(
        "sku_id", "n_train", "n_test", F.col("params").isNotNull().alias("fitted"),
        ((F.col("mape") >= 0) & (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-9)).alias("evaluated"),
        (F.col("mae") < F.col("naive_mae")).alias("beats_naive"), "error")


@register("l3_training_summary")
def training_summary(spark, sf_dir):
    """MAPE, MAE and RMSE per SKU, ascending by MAPE."""
    return M.training_summary(fitted(spark, sf_dir).skus)


@register("l4_random_search", sql=_COUNTS + """
SELECT sku_id, n_train > 100 AS tuned, CASE WHEN n_train > 100 THEN 5 END AS draws, CASE WHEN n_train > 100 THEN 2 END AS folds,
       CASE WHEN n_train > 100 THEN 2 * (n_train // 3) END AS fold_rows, true AS from_draws
FROM counts WHERE n_rows >= 90""")
def random_search(spark, sf_dir):
    """L4: five seeded draws scored on two expanding time folds of every SKU's training rows; the
    chosen parameters are one of the draws (or the defaults below the gate)."""
    m = fitted(spark, sf_dir, tune=True).skus
    params = [{k: str(v) for k, v in asdict(p).items()} for p in [TreeParams(), *M.draw_params(TreeParams())]]
    drawn = F.array(*[F.concat_ws("|", *[F.lit(f"{k}={p[k]}") for k in sorted(p)]) for p in params])
    mine = F.concat_ws("|", F.transform(F.array_sort(F.map_keys("params")),
                                        lambda k: F.concat(k, F.lit("="), F.element_at("params", k))))
    return m.select("sku_id", "tuned", "draws", "folds", "fold_rows", F.array_contains(drawn, mine).alias("from_draws"))


def _scored_all(spark, sf_dir) -> DataFrame:
    return M.score(demand.feature_table(transactions(spark, sf_dir)), fitted(spark, sf_dir))


@register("l9_batch_scoring", sql=_COUNTS + """,
daily_all AS (SELECT sku_id, hospital_id, CAST(transaction_time AS DATE) AS ds, sum(quantity_consumed) AS qty_1d
              FROM transactions GROUP BY 1, 2, 3)
SELECT d.ds, d.hospital_id, d.sku_id, CAST(d.qty_1d AS DOUBLE) AS qty_1d, c.sku_id IS NOT NULL AS predicted,
       CASE WHEN c.sku_id IS NULL THEN 'no model' END AS error
FROM daily_all d LEFT JOIN (SELECT sku_id FROM counts WHERE n_rows >= 90) c ON d.sku_id = c.sku_id""")
def batch_scoring(spark, sf_dir):
    """Every row of the all-SKU feature table scored; rows of SKUs
    without a model get error 'no model' instead of failing the batch."""
    return _scored_all(spark, sf_dir).select("ds", "hospital_id", "sku_id", "qty_1d",
                                             F.col("prediction").isNotNull().alias("predicted"), "error")


@register("l9_batch_values")
def batch_values(spark, sf_dir):
    """The predictions of the batch."""
    return _scored_all(spark, sf_dir).select("ds", "hospital_id", "sku_id", "qty_1d", "prediction", "error")


def _latest(spark, sf_dir) -> DataFrame:
    models = fitted(spark, sf_dir)
    w = Window.partitionBy(*SERIES).orderBy(F.col("ds").desc())
    latest = top_features(spark, sf_dir).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    scored = M.score(latest, models).filter("error is null").join(models.skus.select("sku_id", "mape"), "sku_id", "left")
    return ev.with_interval(scored, "prediction", "mape")


@register("l10_score_latest_interval", sql=_COUNTS + """
SELECT f.hospital_id, f.sku_id, max(f.ds) AS ds, true AS in_bounds, true AS recorded_mape
FROM feats f JOIN counts c ON f.sku_id = c.sku_id WHERE c.n_rows >= 90 GROUP BY 1, 2""")
def score_latest(spark, sf_dir):
    """Latest row of every series scored, with an
    interval from the SKU's recorded MAPE."""
    m = _latest(spark, sf_dir)
    return m.select("hospital_id", "sku_id", "ds", F.col("prediction").between(F.col("lower"), F.col("upper")).alias("in_bounds"),
                    (F.col("mape_used") == F.col("mape")).alias("recorded_mape"))


@register("l10_latest_values")
def latest_values(spark, sf_dir):
    """Latest predictions with their bounds."""
    return _latest(spark, sf_dir).select(*SERIES, "ds", "prediction", "mape_used", "lower", "upper")


def forecast_rows(spark, sf_dir, horizon: int = fc.DEFAULT_HORIZON) -> DataFrame:
    """The served forecast: rounded predictions; the SKU's recorded
    MAPE around the first (rounded) prediction gives the bounds of all days."""
    models = fitted(spark, sf_dir)
    rf = fc.roll_forward(top_features(spark, sf_dir), SERIES, horizon)
    scored = (M.score(rf.withColumn(M.TARGET, F.lit(None).cast("double")), models).filter("error is null")
              .join(models.skus.select("sku_id", "mape"), "sku_id", "left"))
    first = Window.partitionBy(*SERIES).orderBy("step")
    out = scored.select(*SERIES, "step", F.col("ds").alias("date"), "mape",
                        fc.round_prediction(F.col("prediction")).alias("predicted_qty"))
    out = out.withColumn("first_qty", F.first("predicted_qty").over(first).cast("double"))
    return ev.with_interval(out, "first_qty", "mape")


@register("l11_forecast", sql=_COUNTS + """,
ranked AS (SELECT f.hospital_id, f.sku_id, f.ds, count(*) OVER (PARTITION BY f.hospital_id, f.sku_id) AS n,
                  max(f.ds) OVER (PARTITION BY f.hospital_id, f.sku_id) AS last_ds
           FROM feats f JOIN counts c ON f.sku_id = c.sku_id WHERE c.n_rows >= 90)
SELECT DISTINCT hospital_id, sku_id, CAST(s.step AS INTEGER) AS step, CAST(last_ds + CAST(s.step AS INTEGER) AS DATE) AS date,
       true AS ordered, true AS same_bounds
FROM ranked, (SELECT unnest(range(1, 8)) AS step) s WHERE n >= 30""")
def forecast(spark, sf_dir):
    """Keys and dates of the 7-day forecast; the bounds
    are in order and the same for all days of a series."""
    f = forecast_rows(spark, sf_dir)
    w = Window.partitionBy(*SERIES)
    return f.select(*SERIES, "step", "date", (F.col("lower") <= F.col("upper")).alias("ordered"),
                    ((F.max("lower").over(w) == F.min("lower").over(w)) & (F.max("upper").over(w) == F.min("upper").over(w)))
                    .alias("same_bounds"))


@register("l11_forecast_values")
def forecast_values(spark, sf_dir):
    """Predicted quantities, bounds and the mean prediction."""
    return forecast_rows(spark, sf_dir).select(
        *SERIES, "step", "date", "predicted_qty", "lower", "upper",
        F.avg("predicted_qty").over(Window.partitionBy(*SERIES)).alias("mean_predicted"))


@register("b13_summary_csv", sql=_COUNTS + """
SELECT sku_id, n_train, n_rows - n_train AS n_test, true AS ascending FROM counts WHERE n_rows >= 90""")
def summary_csv(spark, sf_dir):
    """The training summary as a CSV ordered by MAPE, read back strictly; `ascending` compares
    each row with the one before it in the file."""
    summary = M.training_summary(fitted(spark, sf_dir).skus)
    path = run_folder(spark, "summary_csv")
    io.write_csv(summary.coalesce(1), path)          # a row per SKU
    back = io.read_csv(spark, path, summary.schema, strict=True).withColumn("line", F.monotonically_increasing_id())
    before = F.lag("mape").over(Window.orderBy("line"))
    return back.withColumn("before", before).select(
        "sku_id", "n_train", "n_test", F.coalesce(F.col("mape") >= F.col("before"), F.lit(True)).alias("ascending"))


@register("b14_scored_batch_csv", sql=_COUNTS + """
SELECT f.hospital_id, f.sku_id, f.ds, CAST(f.qty_1d AS DOUBLE) AS qty_1d, true AS predicted
FROM feats f JOIN counts c ON f.sku_id = c.sku_id WHERE c.n_rows >= 90""")
def scored_batch_csv(spark, sf_dir):
    """The top SKUs' rows from an uploaded CSV, scored, written as a CSV and read back strictly."""
    rows = top_features(spark, sf_dir)
    up = io.write_csv(rows, run_folder(spark, "upload_csv"))
    scored = M.score(io.read_csv(spark, up, rows.schema, strict=True), fitted(spark, sf_dir)).filter("error is null")
    path = io.write_csv(scored, run_folder(spark, "scored_csv"))
    back = io.read_csv(spark, path, scored.schema, strict=True)
    return back.select("hospital_id", "sku_id", "ds", "qty_1d", F.col("prediction").isNotNull().alias("predicted"))


@register("b14_forecast_csv", sql=_COUNTS + """,
ranked AS (SELECT f.hospital_id, f.sku_id, count(*) OVER (PARTITION BY f.hospital_id, f.sku_id) AS n,
                  max(f.ds) OVER (PARTITION BY f.hospital_id, f.sku_id) AS last_ds
           FROM feats f JOIN counts c ON f.sku_id = c.sku_id WHERE c.n_rows >= 90)
SELECT DISTINCT hospital_id, sku_id, CAST(last_ds + CAST(s.step AS INTEGER) AS DATE) AS date, 'Day ' || s.step AS day_label
FROM ranked, (SELECT unnest(range(1, 8)) AS step) s WHERE n >= 30""")
def forecast_csv(spark, sf_dir):
    """The served forecast as a CSV in the order of series and day, read back strictly."""
    f = forecast_rows(spark, sf_dir).select(*SERIES, "date", F.concat(F.lit("Day "), F.col("step").cast("string")).alias("day_label"),
                                            "predicted_qty", "lower", "upper")
    path = io.write_csv(f, run_folder(spark, "forecast_csv"), order_by=[*SERIES, "date"])
    return io.read_csv(spark, path, f.schema, strict=True).select(*SERIES, "date", "day_label")


@register("b20_fitted_runs", sql=_COUNTS + """
SELECT sku_id, kind, key FROM counts, (VALUES ('metric', 'mape'), ('metric', 'mae'), ('metric', 'rmse'), ('metric', 'naive_mae'),
  ('param', 'max_iter'), ('param', 'max_depth'), ('param', 'step_size'), ('param', 'subsampling_rate'), ('param', 'feature_rate'),
  ('param', 'min_rows'), ('param', 'seed')) t(kind, key) WHERE n_rows >= 90""")
def run_metrics(spark, sf_dir):
    """Parameters and metrics of the fitted models, one row each (values without a twin are left out)."""
    skus = fitted(spark, sf_dir).skus
    metrics = M.metrics_table(skus).where("value is not null").select("sku_id", F.lit("metric").alias("kind"), "key")
    return metrics.unionByName(M.params_table(skus).select("sku_id", F.lit("param").alias("kind"), "key"))


@register("l8_model_fallback", sql=_COUNTS + """,
k AS (SELECT sku_id, row_number() OVER (ORDER BY sku_id) AS pos FROM counts WHERE n_rows >= 90)
SELECT sku_id, CASE WHEN pos % 3 = 1 THEN 0 ELSE 1 END AS store FROM k WHERE pos % 3 <> 0""")
def model_fallback(spark, sf_dir):
    """Per SKU the local entry, else the registry's, else none: every third SKU is in the local store, the
    next one only in the registry, the third in neither."""
    skus = fitted(spark, sf_dir).skus
    # one row per SKU of the top list
    pos = skus.where("error is null").withColumn("pos", F.row_number().over(Window.orderBy("sku_id")))
    return M.first_models([pos.where("pos % 3 = 1"), pos.where("pos % 3 <> 0 and pos % 3 <= 2")]).select("sku_id", "store")


RUN_TIMES = (("run-1", 1_700_000_000_000), ("run-2", 1_700_086_400_000))


def _registry(spark, sf_dir):
    """The fitted models registered by two training runs, the second with a tag."""
    from stockpulse.operators.registry_log import RegistryLog
    log = RegistryLog(spark, run_folder(spark, "registry"))
    models = fitted(spark, sf_dir).skus.where("error is null").select(ev.model_name(F.col("sku_id")).alias("model_name"))
    for run, at in RUN_TIMES:
        log.register(models, run, at, tags={"team": "demand", "run": run})
    return log


_REGISTRY_SQL = _COUNTS + """,
m AS (SELECT 'sku_forecast_model_' || sku_id AS model_name FROM counts WHERE n_rows >= 90),
v AS (SELECT model_name, '1' AS version, 'Archived' AS stage, 'run-1' AS run_id, 1700086400000 AS last_updated_ms FROM m
      UNION ALL SELECT model_name, '2', 'Production', 'run-2', 1700086400000 FROM m)"""


@register("l6_registry_log", sql=_REGISTRY_SQL + "\nSELECT * FROM v")
def registry_log(spark, sf_dir):
    """The fitted models registered twice through the transition log: the second version is
    Production, the first archived by the same commit."""
    return _registry(spark, sf_dir).versions()


@register("l7_registry_resolve", sql=_REGISTRY_SQL + """
SELECT v.*, key, CASE key WHEN 'team' THEN 'demand' ELSE run_id END AS value
FROM v, (VALUES ('team'), ('run')) t(key) WHERE stage = 'Production'""")
def registry_resolve(spark, sf_dir):
    """The Production version of every model in the log, with its tags."""
    log = _registry(spark, sf_dir)
    return ev.resolve_model(log.versions(), "Production").join(log.tags(), ["model_name", "version"])


@register("f14_registry_exporter", sql=_REGISTRY_SQL + """
SELECT model_name, max(CAST(version AS INTEGER)) AS latest_version, max(last_updated_ms) / 1000.0 AS last_updated_s,
       1700090000.0 - max(last_updated_ms) / 1000.0 AS age_seconds FROM v GROUP BY model_name""")
def registry_exporter(spark, sf_dir):
    """Latest version and age of every model in the log, an hour after the second run."""
    return ev.exporter_view(_registry(spark, sf_dir).versions(), F.timestamp_seconds(F.lit(1_700_090_000)))
