"""Splits, error metrics, model registry tables and intervals (G12, G13,
F7-F9, F13, F14, F22, D9, D10, E7, H5, J20, J22, L6, L7, L12).

Row positions per key (for the chronological split and the time folds) are
computed without a window over the whole key: rows are counted per (key,
day) (an aggregate), the days are accumulated per key (a window whose
partitions hold one row per day - bounded by the calendar), and only rows
sharing a day are ranked together (a window per (key, day)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TRAIN_FRACTION = 0.8
MIN_TRAIN_ROWS = 90          # rows needed to train a model
MIN_TUNE_ROWS = 100          # train rows above which the search runs
MIN_FORECAST_ROWS = 30       # history rows needed to forecast
FOLDS = 2                    # expanding time-series folds
ZERO_EPS = 1e-8              # |y| below this counts as zero in MAPE
DEFAULT_MAPE = 20.0          # when no MAPE was recorded
Z_95 = 1.96
MODEL_PREFIX = "sku_forecast_model_"


def positions(df: DataFrame, key: str, day: str, tie: str) -> DataFrame:
    """Add `pos` (0-based position within `key` ordered by (day, tie)) and
    `n` (rows of the key)."""
    per_day = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("__nd"))
    wk = Window.partitionBy(key).orderBy(day)
    per_day = per_day.select(
        key, day,
        (F.sum("__nd").over(wk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__nd")).alias("__before"),
        F.sum("__nd").over(Window.partitionBy(key)).alias("n"))
    wd = Window.partitionBy(key, day).orderBy(tie)
    ranked = df.withColumn("__r", F.row_number().over(wd) - 1)
    out = ranked.join(per_day, [key, day])
    return out.withColumn("pos", F.col("__before") + F.col("__r")).drop("__before", "__r")


def chrono_split(df: DataFrame, key: str, day: str, tie: str, frac: float = TRAIN_FRACTION) -> DataFrame:
    """First floor(frac * n) rows of each key (by day, tie) are train."""
    p = positions(df, key, day, tie)
    return p.withColumn("is_train", F.col("pos") < F.floor(F.lit(frac) * F.col("n")))


def time_folds(df: DataFrame, key: str, day: str, tie: str, n_splits: int = FOLDS) -> DataFrame:
    """Expanding folds; test size = n div (n_splits + 1); fold f
    (0-based) trains on rows [0, n - (n_splits - f) * ts) and tests on the
    next ts rows. One output row per (input row, fold) it takes part in."""
    p = positions(df, key, day, tie)
    ts = F.floor(F.col("n") / (n_splits + 1))
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    x = p.withColumn("fold", F.explode(folds))
    train_end = F.col("n") - (F.lit(n_splits) - F.col("fold")) * ts
    role = (F.when(F.col("pos") < train_end, F.lit("train"))
            .when(F.col("pos") < train_end + ts, F.lit("test")))
    return x.withColumn("role", role).where(F.col("role").isNotNull())


def mape_term(y: Column, p: Column) -> Column:
    """F7 per-row term: |y| < eps -> 0 if |p| < eps else 100; else |y-p|/|y|*100."""
    return (F.when(F.abs(y) < ZERO_EPS, F.when(F.abs(p) < ZERO_EPS, F.lit(0.0)).otherwise(F.lit(100.0)))
            .otherwise(F.abs(y - p) / F.abs(y) * 100.0))


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """F7-F9 (+ F12 count): per key MAPE, MAE, RMSE, rows (one aggregate)."""
    err = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(
        F.avg(mape_term(F.col(y), F.col(p))).alias("mape"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.count(F.lit(1)).alias("n_test"))


def history_gates(df: DataFrame, key: str, train_flag: str = "is_train") -> DataFrame:
    """Per key rows / train rows and the three gates."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.count_if(F.col(train_flag)).alias("n_train")).select(
        key, "n_rows", "n_train",
        (F.col("n_rows") >= MIN_TRAIN_ROWS).alias("can_train"),
        (F.col("n_train") > MIN_TUNE_ROWS).alias("can_tune"),
        (F.col("n_rows") >= MIN_FORECAST_ROWS).alias("can_forecast"))


def select_keys(available: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Configured keys that exist; an empty intersection means all
    available keys (one tiny count over the intersection decides)."""
    hit = available.join(wanted, key, "left_semi")
    return hit if hit.limit(1).count() > 0 else available


def model_name(sku: Column) -> Column:
    """J22."""
    return F.concat(F.lit(MODEL_PREFIX), sku.cast("string"))


def register_versions(runs: DataFrame, key: str, run_ts: str, run_id: str) -> DataFrame:
    """One version per training run, numbered per model in run order;
    the newest is Production, earlier ones Archived. The window holds one row
    per run of one model (bounded by the number of retrainings)."""
    w = Window.partitionBy("model_name").orderBy(run_ts, run_id)
    wl = Window.partitionBy("model_name")
    v = runs.withColumn("model_name", model_name(F.col(key)))
    v = v.withColumn("__v", F.row_number().over(w)).withColumn("__max", F.max("__v").over(wl))
    return v.select("model_name", F.col("__v").cast("string").alias("version"),
                    F.when(F.col("__v") == F.col("__max"), "Production").otherwise("Archived").alias("stage"),
                    F.col(run_id).alias("run_id"),
                    (F.unix_micros(F.col(run_ts).cast("timestamp")) / 1000).cast("bigint").alias("last_updated_ms"))


def resolve_model(versions: DataFrame, stage: str | None = None) -> DataFrame:
    """Per model the version to serve: with `stage`, the highest
    numeric version in that stage; otherwise the highest numeric version."""
    v = versions if stage is None else versions.where(F.col("stage") == stage)
    packed = F.struct("version", "stage", "run_id", "last_updated_ms")
    return (v.groupBy("model_name").agg(F.max_by(packed, F.col("version").cast("int")).alias("m"))
            .select("model_name", "m.*"))


def exporter_view(versions: DataFrame, as_of: Column) -> DataFrame:
    """Per model highest numeric version, latest update (s) and
    age in seconds relative to `as_of`."""
    g = versions.groupBy("model_name").agg(
        F.max(F.col("version").cast("int")).alias("latest_version"),
        (F.max("last_updated_ms") / 1000.0).alias("last_updated_s"))
    return g.withColumn("age_seconds", F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.col("last_updated_s"))


def with_interval(df: DataFrame, pred: str, mape: str, z: float = Z_95, base: str | None = None) -> DataFrame:
    """lower/upper = p -/+ z * (mape / 100) * |base| (base = p by
    default; L12 passes the first day's prediction). Missing MAPE -> 20."""
    m = F.coalesce(F.col(mape), F.lit(DEFAULT_MAPE))
    width = F.lit(z) * (m / 100.0) * F.abs(F.col(base or pred))
    return df.withColumn("mape_used", m).withColumn("lower", F.col(pred) - width) \
        .withColumn("upper", F.col(pred) + width)
