"""Latency quantiles from bucket counters, per label and sliding window.

A histogram is a set of counters, one per upper bound, each counting the observations up to
its bound. Here a sample is one row per (label, time) with the counters as an array, so one
row carries a whole histogram from the counters to the quantile:

    counters -> increases since the sample before (aware of resets)
             -> sums over sliding windows -> repair to monotone -> interpolation

The calls are reduced to one row per label and minute by partial aggregation; every later
step is bounded by labels x minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockpulse.operators.monitoring import EVAL_STEP, LATENCY_BUCKETS, RATE_RANGE


def bucket_counters(calls: DataFrame, label: str, value: str, ts: str = "ts", bounds: Sequence[float] = LATENCY_BUCKETS,
                    restart: str = "day") -> DataFrame:
    """(label, minute, buckets): counters per minute with calls, in the order of the bounds and +Inf
    last, that restart with every `restart`."""
    minute = F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz")
    names = [f"b{i}" for i in range(len(bounds) + 1)]
    per = calls.groupBy(label, minute.alias("minute")).agg(
        *[F.count_if(F.col(value) <= b).alias(n) for n, b in zip(names, bounds)], F.count(F.lit(1)).alias(names[-1]))
    since = (Window.partitionBy(label, F.date_trunc(restart, "minute")).orderBy("minute")
             .rowsBetween(Window.unboundedPreceding, 0))
    return per.select(label, "minute", F.array(*[F.sum(n).over(since) for n in names]).alias("buckets"))


def bucket_increases(counters: DataFrame, label: str) -> DataFrame:
    """(label, minute, buckets): increase of every bucket since the label's sample before; a
    bucket that fell was reset and counts from zero, the first sample counts nothing."""
    before = F.lag("buckets").over(Window.partitionBy(label).orderBy("minute"))
    inc = F.zip_with("buckets", "before", lambda v, p: F.when(v >= p, v - p).otherwise(v))
    return (counters.withColumn("before", before)
            .select(label, "minute", F.when(F.col("before").isNull(), F.transform("buckets", lambda v: v - v))
                    .otherwise(inc).alias("buckets")))


def window_buckets(increases: DataFrame, label: str | None, size: int, range_: str = RATE_RANGE,
                   step: str = EVAL_STEP) -> DataFrame:
    """(window_end, label, buckets): increases summed over sliding windows; without a label over all of them."""
    by = [label] if label else []
    w = F.window("minute", range_, step)
    sums = increases.groupBy(w.alias("w"), *by).agg(*[F.sum(F.col("buckets")[i]).alias(f"b{i}") for i in range(size)])
    return sums.select(F.col("w.end").alias("window_end"), *by, F.array(*[f"b{i}" for i in range(size)]).alias("buckets"))


def monotone(buckets: Column, size: int) -> Column:
    """Counters of different times may disagree; no bucket holds less than a smaller one."""
    return F.array(*[buckets[0] if i == 0 else F.greatest(*[buckets[j] for j in range(i + 1)]) for i in range(size)])


def quantile(buckets: Column, q: float, bounds: Sequence[float] = LATENCY_BUCKETS) -> Column:
    """linear interpolation in the first bucket that reaches rank q * total, from 0 or the bound
    below; the largest finite bound if that is +Inf; NULL without observations."""
    total = buckets[len(bounds)].cast("double")
    rank = F.lit(q) * total
    out = F.when(F.coalesce(total, F.lit(0.0)) <= 0, F.lit(None).cast("double"))
    for i, bound in enumerate(bounds):
        low = F.lit(float(bounds[i - 1]) if i else 0.0)
        below = buckets[i - 1].cast("double") if i else F.lit(0.0)
        here = buckets[i].cast("double")
        inside = low + (F.lit(float(bound)) - low) * (rank - below) / F.nullif(here - below, F.lit(0.0))
        out = out.when(here >= rank, F.coalesce(inside, F.lit(float(bound))))
    return out.otherwise(F.lit(float(bounds[-1])))


def window_quantiles(calls: DataFrame, label: str, value: str, quantiles: Sequence[float] = (0.9, 0.95),
                     bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """(window_end, label, quantile, value) per label, and under the label `*` over all labels,
    for sliding windows of five minutes."""
    size = len(bounds) + 1
    inc = bucket_increases(bucket_counters(calls, label, value, bounds=bounds), label)
    per = window_buckets(inc, label, size)
    # the sum over all labels needs no second pass over the increases
    both = per.unionByName(per.groupBy("window_end").agg(*[F.sum(F.col("buckets")[i]).alias(f"b{i}") for i in range(size)])
                           .select("window_end", F.lit("*").alias(label), F.array(*[f"b{i}" for i in range(size)]).alias("buckets")))
    fixed = both.withColumn("buckets", monotone(F.col("buckets"), size))
    each = [F.struct(F.lit(q).alias("quantile"), quantile(F.col("buckets"), q, bounds).alias("value")) for q in quantiles]
    return fixed.select("window_end", label, F.inline(F.array(*each)))
