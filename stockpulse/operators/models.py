"""Demand regressors (L3, L4, L5, L8, L9, L10, L11): one pooled fit for all SKUs.

The source pipeline fits one boosted-tree model per SKU, one after the other. Here the SKUs
share one distributed `GBTRegressor`: every row carries its SKU's own level and spread, taken from
that SKU's training rows, so that the trees can tell the SKUs apart, and one fit uses all
executors however many SKUs or rows there are. Training rows, gates, folds and metrics
stay per SKU: each is split chronologically (first 80 % train), needs 90 rows, and is evaluated on
its own last rows. A SKU whose training rows are unusable is left out with its error.

A fitted model is a folder: `model` (Spark ML's own format) and `skus`, a table with one row
per SKU (counts, encodings, metrics, parameters, error), which is its entry in the registry.
Scoring is a join of the rows with `skus` and the model's `transform`: every input row
comes out once, with a prediction or an error, rows of NULL keys too.
"""

from __future__ import annotations

import random
from dataclasses import asdict, dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.functions.parsing import int_or_zero
from stockpulse.operators import evaluation as ev
from stockpulse.operators.cleaning import require_columns
from stockpulse.session import written_table
from stockpulse.sources.io import is_complete, path_exists

# Model input columns and target.
FEATURE_COLS = ["dow", "is_weekend", "week_of_year", "month", "qty_7d", "qty_28d", "avg_qty_7d",
                "avg_qty_28d", "lag_qty_1d", "lag_qty_7d", "rev_7d", "rev_28d", "avg_rev_7d", "avg_rev_28d"]
TARGET = "qty_1d"
INT_COLS = ["dow", "is_weekend", "week_of_year", "month"]
ENCODINGS = ["sku_mean", "sku_std"]
SEARCH_DRAWS = 5
FEATURE_VERSION = 2          # part of the model store's key; raise it when the inputs of the model change

SKUS_SCHEMA = T.StructType([
    T.StructField("sku_id", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in (*ENCODINGS, "mape", "mae", "rmse", "naive_mae")],
    T.StructField("tuned", T.BooleanType()), T.StructField("draws", T.IntegerType()),
    T.StructField("folds", T.IntegerType()), T.StructField("fold_rows", T.LongType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


@dataclass(frozen=True)
class TreeParams:
    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.2
    subsampling_rate: float = 0.8
    feature_rate: float = 0.8
    min_rows: int = 1
    seed: int = 42

    def regressor(self) -> GBTRegressor:
        return GBTRegressor(featuresCol="__x", labelCol=TARGET, predictionCol="prediction", maxIter=self.max_iter,
                            maxDepth=self.max_depth, stepSize=self.step_size, subsamplingRate=self.subsampling_rate,
                            featureSubsetStrategy=str(float(self.feature_rate)), minInstancesPerNode=self.min_rows,
                            seed=self.seed, maxBins=64)


@dataclass
class Fitted:
    """A model (None if no SKU could be trained) and its table of SKUs."""
    model: GBTRegressionModel | None
    skus: DataFrame

    def save(self, path: str) -> None:
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        self.skus.write.mode("overwrite").parquet(f"{path}/skus")      # written last: its marker completes the folder


def load(spark: SparkSession, path: str) -> Fitted:
    model = GBTRegressionModel.load(f"{path}/model") if path_exists(spark, f"{path}/model") else None
    return Fitted(model, spark.read.schema(SKUS_SCHEMA).parquet(f"{path}/skus"))


def is_saved(spark: SparkSession, path: str) -> bool:
    return is_complete(spark, f"{path}/skus")


def prepare(features: DataFrame) -> DataFrame:
    """Model columns as doubles, in their fixed order."""
    require_columns(features, FEATURE_COLS)                       # D12: name what is missing
    return features.select(*[c for c in features.columns if c not in FEATURE_COLS + [TARGET]],
                           *[F.col(c).cast("double").alias(c) for c in FEATURE_COLS + [TARGET]])


def _usable(columns: list[str]):
    """True if every column holds a finite number."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False))
    return ok


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURE_COLS + ENCODINGS, outputCol="__x").transform(rows)


def draw_params(base: TreeParams, n: int = SEARCH_DRAWS) -> list[TreeParams]:
    """L4: seeded random draws over trees, depth, rate, row and column
    sampling, minimum node size."""
    rng = random.Random(base.seed)
    low, high = max(1, base.max_iter // 2), max(2, base.max_iter)
    return [replace(base, max_iter=rng.randrange(low, high), max_depth=rng.randrange(3, 6),
                    step_size=rng.uniform(0.1, 0.3), subsampling_rate=rng.uniform(0.8, 1.0),
                    feature_rate=rng.uniform(0.8, 1.0), min_rows=rng.randrange(1, 5)) for _ in range(n)]


def search(train: DataFrame, base: TreeParams, candidates: list[TreeParams] | None = None) -> TreeParams:
    """L4: the draw with the lowest mean absolute error over the time folds of `train` (rows with __x, pos
    and n of their SKU's training rows); a draw that cannot be fitted does not take part, without
    any the base holds."""
    candidates = draw_params(base) if candidates is None else candidates
    folds = []
    size = F.floor(F.col("n") / (ev.FOLDS + 1))
    for f in range(ev.FOLDS):                                     # G13: expanding folds, two of them
        end = F.col("n") - (ev.FOLDS - f) * size
        folds.append((train.filter(F.col("pos") < end), train.filter((F.col("pos") >= end) & (F.col("pos") < end + size))))
    best, least = base, float("inf")
    for cand in candidates:
        try:
            errs = [cand.regressor().fit(a).transform(b).agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction")))).first()[0]
                    for a, b in folds]
        except Exception as e:  # noqa: BLE001 - such a draw does not take part
            print(f"draw left out: {type(e).__name__}")
            continue
        if None not in errs and sum(errs) / len(errs) < least:
            best, least = cand, sum(errs) / len(errs)
    return best


def train(features: DataFrame, params: TreeParams = TreeParams(), tune: bool = False,
          skus: list[str] | None = None) -> Fitted:
    """The model of all SKUs (or the configured ones, D9) that pass the 90-row gate."""
    rows = prepare(features).select("sku_id", "hospital_id", "ds", *FEATURE_COLS, TARGET).filter("sku_id is not null")
    if skus is not None:
        rows = rows.filter(F.col("sku_id").isin(skus))
    split = written_table(ev.chrono_split(rows, "sku_id", "ds", "hospital_id")
                          .filter(F.col("n") >= ev.MIN_TRAIN_ROWS).withColumn("__ok", _usable(FEATURE_COLS + [TARGET])), "train-rows")
    level = lambda c: F.when(F.col("is_train") & F.col("__ok"), F.col(c))
    stats = written_table(split.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"),
        F.avg(level(TARGET)).alias("sku_mean"), F.coalesce(F.stddev_pop(level(TARGET)), F.lit(0.0)).alias("sku_std"),
        F.when(F.count_if(~F.col("__ok")) > 0, F.lit("missing values in the training rows")).alias("error")), "train-skus")
    usable = stats.filter("error is null")
    known = split.join(usable.select("sku_id", "n_train", *ENCODINGS), "sku_id")
    if usable.isEmpty():
        return Fitted(None, _skus_table(stats, None, params, tune))
    ready = written_table(vectors(known), "train-vectors")        # fits pass over the rows many times
    training = ready.filter("is_train")
    if tune:
        tunable = training.filter(F.col("n_train") > ev.MIN_TUNE_ROWS).withColumn("n", F.col("n_train"))
        if not tunable.isEmpty():
            params = search(tunable, params)
    model = params.regressor().fit(training)
    scored = model.transform(ready.filter(~F.col("is_train")))
    measured = (ev.regression_metrics(scored, ["sku_id"], TARGET, "prediction").drop("n_test")
                .join(ev.regression_metrics(scored, ["sku_id"], TARGET, "lag_qty_1d").select("sku_id", F.col("mae").alias("naive_mae")), "sku_id"))
    return Fitted(model, written_table(_skus_table(stats, measured, params, tune), "skus"))


def _skus_table(stats: DataFrame, measured: DataFrame | None, params: TreeParams, tune: bool) -> DataFrame:
    out = stats
    if measured is not None:
        out = out.join(measured, "sku_id", "left")
    tuned = F.lit(tune) & (F.col("n_train") > ev.MIN_TUNE_ROWS) & F.col("error").isNull()
    chosen = F.create_map(*[x for k, v in asdict(params).items() for x in (F.lit(k), F.lit(str(v)))])
    more = {"tuned": tuned, "draws": F.when(tuned, F.lit(SEARCH_DRAWS)), "folds": F.when(tuned, F.lit(ev.FOLDS)),
            "fold_rows": F.when(tuned, ev.FOLDS * F.floor(F.col("n_train") / (ev.FOLDS + 1))),
            "params": F.when(F.col("error").isNull(), chosen)}
    for c, value in more.items():
        out = out.withColumn(c, value)
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in SKUS_SCHEMA.fields])


def training_summary(skus: DataFrame) -> DataFrame:
    """One row per SKU, ascending by MAPE, failed SKUs last."""
    return skus.select("sku_id", "n_train", "n_test", "mape", "mae", "rmse", "tuned", "error") \
        .orderBy(F.col("mape").asc_nulls_last(), "sku_id")


def params_table(skus: DataFrame) -> DataFrame:
    """Parameters per fitted SKU, as (sku_id, key, value) rows."""
    return skus.filter("params is not null").select("sku_id", F.explode("params"))


def metrics_table(skus: DataFrame) -> DataFrame:
    """Metrics per fitted SKU, as (sku_id, key, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("mape", "mae", "rmse", "naive_mae")])
    return skus.filter("error is null").select("sku_id", F.inline(pairs))


def score(df: DataFrame, fitted: Fitted) -> DataFrame:
    """Every row of df with a prediction, or with an error ('no model',
    'invalid input') instead of failing the batch. J21 for the integer columns."""
    require_columns(df, FEATURE_COLS)
    if TARGET not in df.columns:
        df = df.withColumn(TARGET, F.lit(None).cast("double"))
    rows = prepare(df.select(*[int_or_zero(F.col(c)).alias(c) if c in INT_COLS else F.col(c) for c in df.columns]))
    names = rows.columns
    known = fitted.skus.filter("error is null").select("sku_id", *ENCODINGS)
    joined = rows.join(known, "sku_id", "left").select(*names, *ENCODINGS)
    error = F.when(F.col("sku_mean").isNull(), "no model").when(~_usable(FEATURE_COLS), "invalid input")
    joined = joined.withColumn("error", F.lit("no model") if fitted.model is None else error)
    if fitted.model is None:
        return joined.select(*names, F.lit(None).cast("double").alias("prediction"), "error")
    # the model sees numbers only; what it makes of the rows with an error is not used
    inputs = [c for c in FEATURE_COLS + ENCODINGS]
    filled = joined.select(*names, "error", *[F.when(F.col("error").isNull(), F.col(c)).otherwise(F.lit(0.0)).alias(f"__{c}") for c in inputs])
    x = VectorAssembler(inputCols=[f"__{c}" for c in inputs], outputCol="__x").transform(filled)
    out = fitted.model.transform(x)
    return out.select(*names, F.when(F.col("error").isNull(), F.col("prediction")).alias("prediction"), "error")


def model_versions(skus: DataFrame, trained_at, run_id) -> DataFrame:
    """The fitted models as one training run of every SKU."""
    runs = skus.filter("error is null").select("sku_id", trained_at.alias("run_ts"), run_id.alias("run_id"))
    return ev.register_versions(runs, "sku_id", "run_ts", "run_id")


def first_models(stores: list[DataFrame]) -> DataFrame:
    """Per SKU the entry of the first store that has a usable one (local folder, then
    registry), with its place in `store`; a SKU in none is skipped."""
    ranked = None
    for i, s in enumerate(stores):
        part = s.filter("error is null").withColumn("store", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    cols = [c for c in ranked.columns if c != "sku_id"]
    return (ranked.groupBy("sku_id").agg(F.min_by(F.struct(*cols), "store").alias("m"))
            .select("sku_id", *[F.col("m")[c].alias(c) for c in cols]))
