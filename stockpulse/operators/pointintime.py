"""Point-in-time (as-of) join with TTL, latest-row tables.

as_of_join
----------
For every entity row (key, t): the feature row of the same key with the
largest (feature_ts, created) such that t - ttl <= feature_ts <= t; NULL
features when there is none. Entity rows are all kept, duplicates included.

Spark has no as-of join. The usual "union + last_value over PARTITION BY key"
puts a key's whole history in one task, and one key may hold a third of all
rows. Here time is cut into buckets of `bucket_seconds`:

1. within a bucket: union entity and feature rows, window partitioned by
   (key, bucket), ordered by (ts, side, created), running `last(feature,
   ignoreNulls)`; each window partition is one key's rows in one bucket;
2. across buckets: one summary row per (key, bucket) (last feature of the
   bucket, from a partial aggregate), and a window over those summaries per
   key carries the last feature of earlier buckets forward - its partitions
   hold one row per bucket, bounded by the time span, not by the data;
3. result = within-bucket match, else the carried one; then the TTL check.

Both windows are running frames (constant memory beyond the sort, which
spills). The only joins are on (key, bucket) with one summary row per pair.

The bucket width is one number per key. With `bucket_seconds=None` hot keys get
narrower buckets than the others (`hot_key_widths`), so that a hot key's busiest minutes are
many tasks while a quiet key's day stays one. Rows without a key match
nothing; they take part under spread-out buckets of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


# Bucket widths the automatic sizing chooses from (divisors of a day, then weeks).
BUCKET_WIDTHS = [1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600,
                 43200, DAY, 7 * DAY]
TARGET_BUCKET_ROWS = 2_000_000


def auto_bucket_seconds(entities: DataFrame, features: DataFrame, key: str, entity_ts: str,
                        feature_ts: str, target_rows: int = TARGET_BUCKET_ROWS) -> int:
    """Widest bucket whose hottest (key, bucket) holds about `target_rows`
    rows, judged from per-(key, day) counts of both inputs (one partial
    aggregate each; only a single number reaches the driver)."""
    day = lambda c: F.floor(_micros(F.col(c)) / (DAY * 1_000_000))
    counts = (entities.select(F.col(key).alias("k"), day(entity_ts).alias("d"))
              .unionByName(features.select(F.col(key).alias("k"), day(feature_ts).alias("d")))
              .groupBy("k", "d").agg(F.count(F.lit(1)).alias("n")))
    hottest = counts.agg(F.max("n")).first()[0] or 1
    # assume rows spread over the day; scale the day down to the target
    fitting = [w for w in BUCKET_WIDTHS if hottest * w / DAY <= target_rows]
    return max(fitting) if fitting else BUCKET_WIDTHS[0]


MAX_HOT_KEYS = 65_536          # keys with a width of their own; bounds what is broadcast
NULL_KEY_BUCKETS = 1024


def hot_key_widths(entities: DataFrame, features: DataFrame, key: str, entity_ts: str, feature_ts: str,
                   target_rows: int = TARGET_BUCKET_ROWS, default_seconds: int = DAY) -> DataFrame | None:
    """(key, width_us) of the keys whose busiest hour would put more than about `target_rows` in a
    default bucket: the widest bucket that keeps the key's busiest minute within it, one second at
    least. None if no key can be hot. The hours are counted for all keys (partial aggregation), the
    minutes for the hot keys only. At most MAX_HOT_KEYS keys: for larger inputs the target grows, as
    so many rows are too many buckets for any cluster otherwise."""
    rows = entities.select(F.col(key).alias("k"), _micros(F.col(entity_ts)).alias("t")).unionByName(
        features.select(F.col(key).alias("k"), _micros(F.col(feature_ts)).alias("t"))).where("k is not null and t is not null")
    total = rows.count()
    per_day = max(default_seconds // 3600, 1)
    target = max(target_rows, per_day * total // MAX_HOT_KEYS)
    if total <= target_rows:
        return None
    hour = F.floor(F.col("t") / 3_600_000_000)
    busy = (rows.groupBy("k", hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max("n").alias("n"))
            .where(F.col("n") * per_day > target).select("k"))
    minute = F.floor(F.col("t") / 60_000_000)
    most = (rows.join(F.broadcast(busy), "k").groupBy("k", minute.alias("m")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("k").agg(F.max("n").alias("n")))
    fits = F.array(*[F.when(F.col("n") * w <= target * 60, F.lit(w * 1_000_000).cast("long")) for w in BUCKET_WIDTHS
                     if w <= default_seconds])
    return most.select("k", F.coalesce(F.array_max(fits), F.lit(BUCKET_WIDTHS[0] * 1_000_000).cast("long")).alias("width_us"))


def as_of_join(entities: DataFrame, features: DataFrame, key: str, entity_ts: str, feature_ts: str,
               feature_cols: list[str], ttl_seconds: int | None, created_col: str | None = None,
               bucket_seconds: int | None = DAY, prefix: str = "") -> DataFrame:
    """`bucket_seconds=None`: days, and narrower buckets for hot keys (`hot_key_widths`)."""
    widths = hot_key_widths(entities, features, key, entity_ts, feature_ts) if bucket_seconds is None else None
    bucket_us = int(bucket_seconds or DAY) * 1_000_000

    def bucketed(rows: DataFrame) -> DataFrame:
        """Adds the bucket; NULL keys, which meet no feature, are spread over buckets of their own."""
        width = F.lit(bucket_us).cast("long")
        if widths is not None:
            rows = rows.join(F.broadcast(widths.withColumnRenamed("k", "__key")), "__key", "left")
            width = F.coalesce(F.col("width_us"), width)
        at = F.when(F.col("__key").isNull(), F.pmod(F.xxhash64("__ts"), F.lit(NULL_KEY_BUCKETS))).otherwise(
            F.floor(F.col("__ts") / width))
        return rows.withColumn("__bucket", at).drop("width_us")
    created = F.col(created_col) if created_col else F.lit(None).cast("long")
    feat_struct = F.struct(_micros(F.col(feature_ts)).alias("__fts"),
                           *[F.col(c).alias(c) for c in feature_cols])
    f = (features.where(F.col(key).isNotNull() & F.col(feature_ts).isNotNull())
         .select(F.col(key).alias("__key"), _micros(F.col(feature_ts)).alias("__ts"),
                 F.lit(0).alias("__side"), created.alias("__created"),
                 feat_struct.alias("__feat")))
    f = bucketed(f)

    ent_cols = entities.columns
    ent_struct = F.struct(*[F.col(f"`{c}`").alias(c) for c in ent_cols])
    e = entities.select(F.col(key).alias("__key"), _micros(F.col(entity_ts)).alias("__ts"),
                        F.lit(1).alias("__side"), F.lit(None).cast(f.schema["__created"].dataType).alias("__created"),
                        F.lit(None).cast(f.schema["__feat"].dataType).alias("__feat"),
                        ent_struct.alias("__ent"))
    e = bucketed(e)
    f = f.withColumn("__ent", F.lit(None).cast(e.schema["__ent"].dataType))

    # 1. within-bucket running last feature; entity payload rides along
    u = e.unionByName(f)
    w = (Window.partitionBy("__key", "__bucket").orderBy("__ts", "__side", F.col("__created").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, 0))
    within = (u.withColumn("__in", F.last("__feat", ignorenulls=True).over(w))
              .where(F.col("__side") == 1).select("__key", "__bucket", "__ts", "__ent", "__in"))

    # 2. carry: last feature of strictly earlier buckets, per (key, bucket)
    fb = f.groupBy("__key", "__bucket").agg(
        F.max_by("__feat", F.struct("__ts", F.col("__created"))).alias("__last"))
    eb = (e.where(F.col("__key").isNotNull()).select("__key", "__bucket").distinct()
          .withColumn("__last", F.lit(None).cast(fb.schema["__last"].dataType)))
    summ = fb.unionByName(eb).groupBy("__key", "__bucket").agg(F.max("__last").alias("__last"))
    wb = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select("__key", "__bucket", F.last("__last", ignorenulls=True).over(wb).alias("__carry"))

    m = within.join(carry, ["__key", "__bucket"], "left")
    best = F.coalesce(F.col("__in"), F.col("__carry"))
    ok = best.isNotNull()
    if ttl_seconds is not None:
        ok = ok & (best["__fts"] >= F.col("__ts") - int(ttl_seconds) * 1_000_000)
    return m.select(*[F.col(f"__ent.`{c}`").alias(c) for c in ent_cols],
                    *[F.when(ok, best[c]).alias(prefix + c) for c in feature_cols])


def latest_per_key(features: DataFrame, key: str, ts: str, cols: list[str],
                   created_col: str | None = None) -> DataFrame:
    """Latest row per key by (ts, created). A `max_by`
    aggregate: partial on the map side, so a hot key is reduced before the
    shuffle instead of being sorted in one task."""
    order = F.struct(F.col(ts), F.col(created_col)) if created_col else F.struct(F.col(ts))
    packed = F.struct(F.col(ts).alias(ts), *[F.col(c).alias(c) for c in cols if c != ts],
                      *([F.col(created_col).alias(created_col)] if created_col and created_col not in cols else []))
    agg = features.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(packed, order).alias("__r"))
    return agg.select(key, "__r.*")


def online_lookup(keys: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Look up entity keys in the latest table; unknown keys -> NULLs."""
    return keys.join(latest, key, "left")


def materialize_incremental(latest: DataFrame | None, source: DataFrame, key: str, ts: str, cols: list[str],
                            start, end, created_col: str | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """K2: fold rows with start < ts <= end into the latest table; a late row
    never replaces a newer stored one (max by (ts, created) again). Without a
    start (the first run) the view's TTL before the end bounds the rows."""
    window = source.where(F.col(ts) <= F.lit(end))
    if start is not None:
        window = window.where(F.col(ts) > F.lit(start))
    elif ttl_seconds is not None:
        window = window.where(F.col(ts) >= F.lit(end) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    fresh = latest_per_key(window, key, ts, cols, created_col)
    if latest is None:
        return fresh
    return latest_per_key(latest.unionByName(fresh), key, ts, cols, created_col)


def run_materialization(spark, store: str, source: DataFrame, key: str, ts: str, cols: list[str], end,
                        created_col: str | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """K2 with its state: `store` holds one folder per run with the latest table
    and, in its name, the run's end mark in microseconds. A run starts at the
    highest complete mark; a repeated end changes nothing; a run that was cut off left no
    complete folder and is made again. The folder before the newest is deleted."""
    from stockpulse.sources.io import complete_marks, delete_path
    end_us = spark.range(1).select(F.unix_micros(end.cast("timestamp"))).first()[0]
    marks = complete_marks(spark, store, "end=")
    if not marks or marks[-1] < end_us:
        before = marks[-1] if marks else None
        stored = spark.read.parquet(f"{store}/end={before}") if marks else None
        start = F.timestamp_micros(F.lit(before)).cast(source.schema[ts].dataType) if marks else None
        table = materialize_incremental(stored, source, key, ts, cols, start, end, created_col, ttl_seconds)
        table.write.mode("overwrite").parquet(f"{store}/end={end_us}")
        for old in marks[:-1]:
            delete_path(spark, f"{store}/end={old}")
    return spark.read.parquet(f"{store}/end={max([end_us, *marks])}")
