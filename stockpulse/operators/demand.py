"""Daily demand, top-k SKUs and the rolling/lag feature windows (F1-F3, H1,
E1-E4, G1-G11).

Plan shape at scale
-------------------
* `daily_demand` is a `groupBy(sku, hospital, day)`: Spark aggregates partially
  on the map side, so a hot SKU (a third of all rows) shuffles one partial row
  per (task, series, day), not its raw rows.
* The top-k ranking is computed from the daily table (sum of daily sums equals
  the sum over transactions), so the fact table is scanned once. The ranking
  is a second small partial/final aggregate plus `TakeOrderedAndProject`; its
  output has k rows by construction and is the only broadcast.
* All feature windows share one partition/order spec, so Catalyst emits one
  Exchange + one Sort + one Window node. A window partition is one series and
  holds one row per observed day, so its size is bounded by the calendar, not
  by the data volume.
* Sums run over exact decimals (revenue) or integral doubles (quantity) and
  averages are `sum / count`, so results do not depend on the summation order
  and match the SQL oracle exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockpulse.functions.calendar import TRAINING, calendar_columns
from stockpulse.plans.joins import topk_broadcast

# Frame lengths in rows (ROWS frames count observed days).
SHORT_ROWS = 7
LONG_ROWS = 28
EVENT_LONG_ROWS = 30
TOP_K = 10

SERIES_KEYS = ["hospital_id", "sku_id"]


UNITS = "revenue_units"          # exact long revenue (1e-4 units), when the input has it
REVENUE_SCALE = 10_000.0


def daily_demand(tx: DataFrame, keep_decimal: bool = False) -> DataFrame:
    """sum quantity and revenue per (sku, hospital, day).

    With a `revenue_units` column the revenue is summed as exact longs; the
    double result is units / 1e4 (correctly rounded, as a decimal->double
    cast is). `keep_decimal=True` keeps the exact representation (units, or
    the decimal sum) for further window sums."""
    keys = ["sku_id", "hospital_id", F.to_date("transaction_time").alias("tx_date")]
    if UNITS in tx.columns:
        out = tx.groupBy(*keys).agg(F.sum("quantity_consumed").alias("total_quantity"),
                                    F.sum(UNITS).alias(UNITS))
        if keep_decimal:
            return out
        return out.select("sku_id", "hospital_id", "tx_date", "total_quantity",
                          (F.col(UNITS) / REVENUE_SCALE).alias("total_revenue"))
    out = tx.groupBy(*keys).agg(F.sum("quantity_consumed").alias("total_quantity"),
                                F.sum("total_revenue").alias("total_revenue"))
    if not keep_decimal:
        out = out.withColumn("total_revenue", F.col("total_revenue").cast("double"))
    return out


def sku_totals(df: DataFrame, qty_col: str = "quantity_consumed") -> DataFrame:
    """total quantity per SKU (the ranking key)."""
    return df.groupBy("sku_id").agg(F.sum(qty_col).alias("total_quantity"))


def top_skus(df: DataFrame, k: int = TOP_K, qty_col: str = "quantity_consumed") -> DataFrame:
    """H1: k SKUs with the largest total quantity; ties broken by sku_id."""
    return (sku_totals(df, qty_col)
            .orderBy(F.col("total_quantity").desc(), F.col("sku_id").asc())
            .limit(k))


def restrict_to(df: DataFrame, top: DataFrame) -> DataFrame:
    """Keep rows whose SKU is in `top` (semi join, broadcast: `top` is a
    top-k result). Placed before the windows: valid because sku_id is part of
    the window partition key, so whole series are kept or dropped."""
    return df.join(topk_broadcast(top.select("sku_id")), "sku_id", "left_semi")


def _avg(col: str, w) -> F.Column:
    return F.sum(col).over(w).cast("double") / F.count(col).over(w)


def demand_features(daily: DataFrame) -> DataFrame:
    """G1-G8 + J2-J5: the 19-column daily feature table.

    `daily` may carry revenue as decimal (exact sums) or double.
    Frames are ROWS frames that include the current row, as in the source
    tables (so qty_7d includes the target qty_1d; kept for parity)."""
    w = Window.partitionBy(*SERIES_KEYS).orderBy("tx_date")
    w7 = w.rowsBetween(-(SHORT_ROWS - 1), 0)
    w28 = w.rowsBetween(-(LONG_ROWS - 1), 0)
    if UNITS in daily.columns:                       # exact long revenue units
        daily = daily.withColumnRenamed(UNITS, "total_revenue")
        rev = lambda c: F.col(c) / REVENUE_SCALE      # noqa: E731
    else:
        rev = lambda c: F.col(c).cast("double")       # noqa: E731
    # each frame aggregate once; averages derive from the sums and counts
    win = daily.select(
        "tx_date", "hospital_id", "sku_id", "total_quantity", "total_revenue",
        F.sum("total_quantity").over(w7).alias("qty_7d"),
        F.sum("total_quantity").over(w28).alias("qty_28d"),
        F.count("total_quantity").over(w7).alias("__nq7"),
        F.count("total_quantity").over(w28).alias("__nq28"),
        F.lag("total_quantity", 1, 0.0).over(w).alias("lag_qty_1d"),
        F.lag("total_quantity", 7, 0.0).over(w).alias("lag_qty_7d"),
        F.sum("total_revenue").over(w7).alias("__r7"),
        F.sum("total_revenue").over(w28).alias("__r28"),
        F.count("total_revenue").over(w7).alias("__nr7"),
        F.count("total_revenue").over(w28).alias("__nr28"),
    )
    return win.select(
        F.col("tx_date").alias("ds"),
        "hospital_id",
        "sku_id",
        *calendar_columns(F.col("tx_date"), TRAINING),
        F.col("total_quantity").alias("qty_1d"),
        "qty_7d",
        "qty_28d",
        (F.col("qty_7d").cast("double") / F.col("__nq7")).alias("avg_qty_7d"),
        (F.col("qty_28d").cast("double") / F.col("__nq28")).alias("avg_qty_28d"),
        "lag_qty_1d",
        "lag_qty_7d",
        rev("total_revenue").alias("rev_1d"),
        rev("__r7").alias("rev_7d"),
        rev("__r28").alias("rev_28d"),
        (rev("__r7") / F.col("__nr7")).alias("avg_rev_7d"),
        (rev("__r28") / F.col("__nr28")).alias("avg_rev_28d"),
    )


# The columns of the feature table.
FEATURE_COLUMNS = ["ds", "hospital_id", "sku_id", "dow", "is_weekend", "week_of_year", "month",
                   "qty_1d", "qty_7d", "qty_28d", "avg_qty_7d", "avg_qty_28d", "lag_qty_1d",
                   "lag_qty_7d", "rev_1d", "rev_7d", "rev_28d", "avg_rev_7d", "avg_rev_28d"]


def feature_table(tx: DataFrame) -> DataFrame:
    """B9 (all SKUs): transactions -> daily -> features."""
    return demand_features(daily_demand(tx, keep_decimal=True))


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table as Parquet in the shared folder and read it
    back: it survives executor loss and keeps statistics, pruning and pushdown."""
    from stockpulse.session import written_table
    return written_table(df, "daily")


def feature_table_top(tx: DataFrame, k: int = TOP_K) -> DataFrame:
    """B9 (top k): transactions -> daily (materialised, as the daily table is
    in the source pipeline) -> semi join top k -> features. Materialising
    matters: otherwise Catalyst pushes the semi join below the daily
    aggregate and the ranking branch recomputes the whole fact-table scan."""
    daily = materialize(daily_demand(tx, keep_decimal=True))
    top = top_skus(daily, k, qty_col="total_quantity")
    return demand_features(restrict_to(daily, top))


def sku_day_demand(tx: DataFrame) -> DataFrame:
    """daily quantity per (sku, day), no hospital split."""
    return (tx.groupBy("sku_id", F.to_date("transaction_time").alias("date"))
            .agg(F.sum("quantity_consumed").alias("daily_qty")))


def sku_day_features(daily: DataFrame) -> DataFrame:
    """G9-G11 over a per-SKU daily series (lag default NULL, not 0)."""
    w = Window.partitionBy("sku_id").orderBy("date")
    w7 = w.rowsBetween(-(SHORT_ROWS - 1), 0)
    w30 = w.rowsBetween(-(EVENT_LONG_ROWS - 1), 0)
    return daily.select(
        "sku_id", "date", "daily_qty",
        F.lag("daily_qty", 1).over(w).alias("lag_1"),
        F.sum("daily_qty").over(w7).alias("qty_last_7_days"),
        F.sum("daily_qty").over(w30).alias("qty_last_30_days"),
        _avg("daily_qty", w7).alias("avg_last_7"),
        _avg("daily_qty", w30).alias("avg_last_30"),
    )


def event_features(tx: DataFrame, k: int = TOP_K) -> DataFrame:
    """Event-grain features for the top-k SKUs.

    Every top-k transaction gets its day's window features (E4: left join on
    (sku_id, day)); missing values -> 0 (J11). The daily side has at most
    k x days rows; the join is left to AQE, which broadcasts it when its
    measured shuffle output is small and otherwise splits skewed partitions
    of the transaction side (top-k SKUs are, by definition, the hot keys).
    The ranking is taken from the materialised (sku, day) aggregate, so the
    fact table is scanned twice in all: once aggregated, once for the event
    rows.
    """
    all_daily = materialize(sku_day_demand(tx))     # one aggregate pass over the facts
    top = top_skus(all_daily, k, qty_col="daily_qty")
    feats = sku_day_features(restrict_to(all_daily, top))
    tx_top = restrict_to(tx, top)
    ev = (tx_top.select("sku_id", "transaction_time", "quantity_consumed",
                        F.to_date("transaction_time").alias("date"))
          .join(feats.drop("daily_qty"), ["sku_id", "date"], "left"))
    return ev.select(
        "sku_id",
        F.col("transaction_time").alias("feature_timestamp"),
        "quantity_consumed",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
          for c in ["lag_1", "qty_last_7_days", "qty_last_30_days", "avg_last_7", "avg_last_30"]],
    )
