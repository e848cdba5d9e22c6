"""Feature-registry queries over `events`: as-of join, online lookup,
incremental materialisation, on-demand views and services.

Mapping: entity = user (user_id); feature rows = non-purchase events (value,
event_type; `event_id` orders rows with equal timestamps, like a created
column); entity rows = purchase events, whose `props.k` is a request-time
value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stockpulse.operators import featureviews as fv
from stockpulse.operators.pointintime import latest_per_key, run_materialization
from stockpulse.plans.registry import register
from stockpulse.session import run_folder
from stockpulse.sources.tables import read_table

TTL_SECONDS = 6 * 3600
USER = fv.Entity("user", "user_id")


def activity_view(spark, sf_dir) -> fv.FeatureView:
    ev = read_table(spark, sf_dir, "events")
    src = ev.where(F.col("event_type") != "purchase").select("user_id", "ts", "event_id", "value", "event_type")
    return fv.FeatureView("user_activity", USER, src, "ts", {"value": "double", "event_type": "string"},
                          ttl_seconds=TTL_SECONDS, created_field="event_id", tags={"team": "demand"})


def value_plus_request() -> fv.OnDemandView:
    return fv.OnDemandView("value_plus_request", ["user_activity"], ["val_to_add"],
                           lambda df: df.withColumn("value_plus_val", F.col("value") + F.col("val_to_add")),
                           ["value_plus_val"])


def registry(spark, sf_dir) -> fv.FeatureRegistry:
    return fv.FeatureRegistry().apply(
        activity_view(spark, sf_dir), value_plus_request(),
        fv.FeatureService("activity_v1", ["user_activity:value", "value_plus_request"]))


def purchase_entities(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("event_timestamp"), "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("val_to_add"))


_ENT_SQL = """ent AS (SELECT user_id, ts AS event_timestamp, event_id,
                   CAST(json_extract_string(props, '$.k') AS BIGINT) AS val_to_add
            FROM events WHERE event_type = 'purchase'),
feat AS (SELECT user_id, ts, event_id AS created, value, event_type FROM events WHERE event_type <> 'purchase')"""
_ASOF_SQL = f"""WITH {_ENT_SQL},
j AS (SELECT e.*, f.ts AS fts, f.value AS fvalue, f.event_type AS ftype
      FROM ent e ASOF LEFT JOIN feat f ON e.user_id = f.user_id AND e.event_timestamp >= f.ts)
"""
_OK = f"fts IS NOT NULL AND fts >= event_timestamp - INTERVAL {TTL_SECONDS} SECOND"


@register("e5_point_in_time", sql=_ASOF_SQL + f"""
SELECT user_id, event_timestamp, event_id, val_to_add,
       CASE WHEN {_OK} THEN fvalue END AS value, CASE WHEN {_OK} THEN ftype END AS event_type FROM j""")
def point_in_time(spark, sf_dir):
    """As-of join with TTL (6 h) against a registered feature
    view over a Parquet source; ties broken by the created column."""
    reg = registry(spark, sf_dir)
    return reg.historical(purchase_entities(spark, sf_dir), ["user_activity:value", "user_activity:event_type"])


@register("e5_point_in_time_hourly_buckets", sql=_ASOF_SQL + f"""
SELECT user_id, event_timestamp, event_id, val_to_add,
       CASE WHEN {_OK} THEN fvalue END AS value, CASE WHEN {_OK} THEN ftype END AS event_type FROM j""")
def point_in_time_hourly(spark, sf_dir):
    """E5 with 1-hour time buckets: most matches come through the carry step."""
    reg = registry(spark, sf_dir)
    return reg.historical(purchase_entities(spark, sf_dir), ["user_activity:value", "user_activity:event_type"],
                          bucket_seconds=3600)


@register("l1_on_demand_service", sql=_ASOF_SQL + f"""
SELECT user_id, event_timestamp, event_id, val_to_add,
       CASE WHEN {_OK} THEN fvalue END AS value,
       CASE WHEN {_OK} THEN fvalue END + val_to_add AS value_plus_val FROM j""")
def on_demand_service(spark, sf_dir):
    """Feature service = one view feature + an
    on-demand view fed by a request-time column."""
    reg = registry(spark, sf_dir)
    return reg.historical(purchase_entities(spark, sf_dir), "activity_v1")


def _plus_request(batch):
    import pyarrow.compute as pc
    return {"value_plus_val": pc.add(batch.column("value"), batch.column("val_to_add").cast("double"))}


@register("l1_on_demand_vectorised", sql=_ASOF_SQL + f"""
SELECT user_id, event_timestamp, event_id, val_to_add,
       CASE WHEN {_OK} THEN fvalue END AS value,
       CASE WHEN {_OK} THEN fvalue END + val_to_add AS value_plus_val FROM j""")
def on_demand_vectorised(spark, sf_dir):
    """L1: the on-demand view as a function of Arrow batches with a declared output schema."""
    view = fv.BatchOnDemandView("value_plus_batch", ["user_activity"], ["val_to_add"], _plus_request,
                                {"value_plus_val": "double"}, inputs=["value", "val_to_add"])
    reg = registry(spark, sf_dir).apply(view, fv.FeatureService("activity_v2", ["user_activity:value", "value_plus_batch"]))
    return reg.historical(purchase_entities(spark, sf_dir), "activity_v2")


@register("c11_views_of_one_feature_name", sql=_ASOF_SQL + f""",
b AS (SELECT j.*, p.ts AS pts, p.value AS pvalue FROM j ASOF LEFT JOIN
      (SELECT user_id, ts, value FROM events WHERE event_type = 'view') p
      ON j.user_id = p.user_id AND j.event_timestamp >= p.ts)
SELECT user_id, event_timestamp, event_id, val_to_add, CASE WHEN {_OK} THEN fvalue END AS user_activity__value,
       CASE WHEN {_OK} THEN ftype END AS event_type, pvalue AS page_views__value FROM b""")
def views_of_one_feature_name(spark, sf_dir):
    """C11 / L2: a service over two views that both have a feature `value`."""
    ev = read_table(spark, sf_dir, "events")
    views = ev.where(F.col("event_type") == "view").select("user_id", "ts", "event_id", "value")
    reg = registry(spark, sf_dir).apply(
        fv.FeatureView("page_views", USER, views, "ts", {"value": "double"}, ttl_seconds=None, created_field="event_id"),
        fv.FeatureService("both", ["user_activity", "page_views"]))
    return reg.historical(purchase_entities(spark, sf_dir), "both")


@register("e6_online_lookup", sql="""
WITH latest AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type
                FROM events WHERE event_type <> 'purchase' GROUP BY user_id)
SELECT c.c_custkey AS user_id, l.value, l.event_type
FROM customer c LEFT JOIN latest l ON c.c_custkey = l.user_id""")
def online_lookup(spark, sf_dir):
    """Online lookup of every customer key; keys without events -> NULL."""
    keys = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    reg = registry(spark, sf_dir)
    return reg.online(keys, ["user_activity:value", "user_activity:event_type"])


@register("k2_materialize_incremental", sql="""
SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value,
       arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id
FROM events WHERE event_type <> 'purchase' AND ts <= TIMESTAMP '2024-02-01 00:00:00'
  AND ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 6 HOUR GROUP BY user_id""")
def materialize(spark, sf_dir):
    """K2: two incremental runs (to Jan 15, then to Feb 1), the second from the
    stored end mark of the first, which the view's TTL bounds."""
    v = activity_view(spark, sf_dir)
    store = run_folder(spark, "latest")
    for day in ("2024-01-15 00:00:00", "2024-02-01 00:00:00"):
        out = run_materialization(spark, store, v.source, "user_id", "ts", ["value", "event_type"],
                                  F.lit(day).cast("timestamp_ntz"), "event_id", v.ttl_seconds)
    return out


@register("g15_latest_event_per_user", sql="""
SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value,
       arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id""")
def latest_event(spark, sf_dir):
    """Latest row per key (max_by, partial aggregation)."""
    ev = read_table(spark, sf_dir, "events")
    return latest_per_key(ev, "user_id", "ts", ["value", "event_type"], "event_id")


_LATEST_SQL = """
SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value,
       arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id
FROM events WHERE event_type <> 'purchase' GROUP BY user_id"""


def _push(spark, source: str, schema, run: str, **options):
    """Replay a folder of event files into the stores of a new target."""
    from stockpulse.streaming.push import PushTarget, push_stream as start
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
              .where(F.col("event_type") != "purchase"))
    target = PushTarget(run, "user_id", "ts", ["value", "event_type"], created="event_id")
    q = start(stream, target, f"{run}/_checkpoint", **options)
    q.awaitTermination()
    return target, q.lastProgress


@register("k1_push_stream", sql=_LATEST_SQL)
def push_stream(spark, sf_dir):
    """Replay the events as a stream (availableNow) into the offline
    and online stores; the result is the final online (latest) table."""
    from stockpulse.sources.tables import stream_path
    from stockpulse.streaming.push import read_online
    ev = read_table(spark, sf_dir, "events")
    # the table may be one file or a folder of part files
    target, progress = _push(spark, stream_path(spark, sf_dir, "events"), ev.schema, run_folder(spark, "push"))
    if not progress and not ev.isEmpty():
        raise RuntimeError("the stream saw no file of a table that has rows")
    return read_online(spark, target)


@register("k1_push_late_batches", sql=_LATEST_SQL)
def push_late_batches(spark, sf_dir):
    """K1: the events in four micro-batches, dealt by hash, so that most rows of a batch are late; each
    batch merges into the buckets of its keys only."""
    from stockpulse.streaming.push import read_online
    run = run_folder(spark, "push_late")
    ev = read_table(spark, sf_dir, "events")
    ev.repartition(4, "event_id").write.parquet(f"{run}/source")
    target, _ = _push(spark, f"{run}/source", ev.schema, run)
    return read_online(spark, target)


@register("k1_push_repeated_events", sql="""
SELECT user_id, ts, value, event_type, event_id FROM events WHERE event_type <> 'purchase'""")
def push_repeated_events(spark, sf_dir):
    """K1: a source that sends every file twice; duplicates are dropped by (key, event id) within a day of
    event time, so the offline table holds every event once."""
    run = run_folder(spark, "push_twice")
    ev = read_table(spark, sf_dir, "events")
    lo, hi = ev.agg(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))), F.unix_seconds(F.max(F.col("ts").cast("timestamp")))).first()
    if lo is None:
        return ev.select("user_id", "ts", "value", "event_type", "event_id")
    third = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - lo) * 3 / (hi - lo + 1))
    for i in (0, 0, 1, 1, 2, 2):           # files in the order of time, each sent again
        ev.where(third == i).coalesce(1).write.mode("append").parquet(f"{run}/source")
    target, _ = _push(spark, f"{run}/source", ev.schema, run, identity=["user_id", "event_id"], delay="1 day")
    return spark.read.parquet(target.offline).select("user_id", "ts", "value", "event_type", "event_id")


@register("k1_store_lookup", sql="""
WITH latest AS (SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value,
                       arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id
                FROM events WHERE event_type <> 'purchase' GROUP BY user_id)
SELECT c.c_custkey AS user_id, ts, value, event_type, event_id FROM customer c LEFT JOIN latest l ON c.c_custkey = l.user_id""")
def store_lookup(spark, sf_dir):
    """Every customer key looked up in the bucketed online store."""
    from stockpulse.sources.tables import stream_path
    ev = read_table(spark, sf_dir, "events")
    target, _ = _push(spark, stream_path(spark, sf_dir, "events"), ev.schema, run_folder(spark, "push_lookup"))
    keys = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return target.store.lookup(keys, ev.schema)
