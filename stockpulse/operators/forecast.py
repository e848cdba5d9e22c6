"""Multi-day roll-forward forecast features.

For every series at once: take its last `HISTORY_ROWS` rows (a window top-k,
which Spark evaluates with a per-partition group limit before the shuffle),
pack quantity and revenue into two arrays of at most 35 elements, extend them
`horizon` times with the mean of their last 7 values (the model output is not
fed back), and emit one feature row per future day. Everything is built-in
higher-order functions; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockpulse.functions.calendar import FORECAST, calendar_columns

# Fixed values.
HISTORY_ROWS = 35
MIN_HISTORY = 30
DEFAULT_HORIZON = 7
MAX_HORIZON = 90


def check_horizon(h: int) -> int:
    """Horizon must be within 1..90."""
    if not 1 <= int(h) <= MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {MAX_HORIZON}, got {h}")
    return int(h)


def last_rows(features: DataFrame, keys: list[str], n: int = HISTORY_ROWS) -> DataFrame:
    """The last n rows per series (by ds)."""
    w = Window.partitionBy(*keys).orderBy(F.col("ds").desc())
    return features.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def history_arrays(features: DataFrame, keys: list[str], n: int = HISTORY_ROWS) -> DataFrame:
    """Per series: qty/rev arrays of the last n rows in date order, row count,
    last date. Series with fewer than 30 rows are dropped (gate)."""
    tail = last_rows(features, keys, n)
    g = tail.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ds", "qty_1d", "rev_1d"))).alias("__h"),
        F.max("ds").alias("last_ds"))
    return (g.where(F.size("__h") >= MIN_HISTORY)
            .select(*keys, "last_ds", F.col("__h.qty_1d").alias("qty_hist"), F.col("__h.rev_1d").alias("rev_hist")))


def _sum(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def _extend(hist, horizon: int):
    """Append mean(last 7) `horizon` times."""
    def step(acc, _i):
        return F.concat(acc, F.array(_sum(F.slice(acc, -7, 7)) / 7.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), hist, step)


def roll_forward(features: DataFrame, keys: list[str], horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """One feature row per (series, future day 1..horizon)."""
    horizon = check_horizon(horizon)
    h = history_arrays(features, keys)
    h = h.select(*keys, "last_ds", F.size("qty_hist").alias("__n"),
                 _extend(F.col("qty_hist"), horizon).alias("__q"),
                 _extend(F.col("rev_hist"), horizon).alias("__r"))
    x = h.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    end = F.col("__n") + F.col("step") - 1          # 1-based index of the last known value

    def win(arr, k):
        start = F.greatest(end - k + 1, F.lit(1))
        return F.slice(F.col(arr), start, F.least(end, F.lit(k)))
    ds = F.date_add(F.col("last_ds"), F.col("step"))
    q7, q28, r7, r28 = _sum(win("__q", 7)), _sum(win("__q", 28)), _sum(win("__r", 7)), _sum(win("__r", 28))
    return x.select(
        *keys, "step", ds.alias("ds"),
        *calendar_columns(ds, FORECAST),
        F.element_at("__q", end).alias("lag_qty_1d"),
        F.when(end >= 7, F.element_at("__q", end - 6)).otherwise(F.element_at("__q", end)).alias("lag_qty_7d"),
        q7.alias("qty_7d"), q28.alias("qty_28d"), (q7 / 7.0).alias("avg_qty_7d"), (q28 / 28.0).alias("avg_qty_28d"),
        r7.alias("rev_7d"), r28.alias("rev_28d"), (r7 / 7.0).alias("avg_rev_7d"), (r28 / 28.0).alias("avg_rev_28d"),
    )


def round_prediction(p) -> F.Column:
    """Round half to even, to int."""
    return F.bround(p, 0).cast("int")
