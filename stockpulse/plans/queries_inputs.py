"""Input and rule queries over rows made dirty by expression (A1, A3, A9-A11,
C2, C12, C14, D1, D3, D5, D8, D14, J9, J10, J12, J13).

The given tables hold no bad values, so the queries derive some from the keys, over
the whole table: unparseable numbers and dates, sentinels, NULL keys, negative
quantities. The twins use the same expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockpulse.functions import parsing as P
from stockpulse.operators import cleaning, featureviews as fv, landing, rules
from stockpulse.plans.queries_quality import _LANDING_SQL
from stockpulse.plans.registry import register
from stockpulse.session import delete_at_end, scratch_path
from stockpulse.sources import io
from stockpulse.sources.tables import landing_transactions, read_table, sku_master, table_path

# A row's number: the order line's key; its remainders choose the fault.
_NO = "CAST(transaction_id AS BIGINT)"
_DIRTY_SQL = _LANDING_SQL + f""",
dirty AS (
  SELECT * REPLACE (
    CASE WHEN {_NO} % 13 = 0 THEN NULL ELSE sku_id END AS sku_id,
    CASE {_NO} % 11 WHEN 0 THEN '-' || quantity_consumed WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE quantity_consumed END AS quantity_consumed,
    CASE {_NO} % 17 WHEN 0 THEN 'yesterday' WHEN 1 THEN NULL
         ELSE strftime(transaction_time, '%Y-%m-%d') END AS transaction_time,
    CASE WHEN {_NO} % 19 = 0 THEN ' A_f-X ' ELSE transaction_type END AS transaction_type)
  FROM landing),
typed AS (
  SELECT * REPLACE (TRY_CAST(quantity_consumed AS DOUBLE) AS quantity_consumed,
                    TRY_CAST(TRY_CAST(transaction_time AS DATE) AS TIMESTAMP) AS transaction_time) FROM dirty)"""


def dirty_landing(spark, sf_dir):
    no = F.col("transaction_id").cast("bigint")
    q, t = F.col("quantity_consumed"), F.col("transaction_time")
    return landing_transactions(spark, sf_dir).withColumns({
        "sku_id": F.when(no % 13 != 0, F.col("sku_id")),
        "quantity_consumed": F.when(no % 11 == 0, F.concat(F.lit("-"), q)).when(no % 11 == 1, "n/a").when(no % 11 == 2, "").otherwise(q),
        "transaction_time": F.when(no % 17 == 0, "yesterday").when(no % 17 != 1, F.date_format(t, "yyyy-MM-dd")),
        "transaction_type": F.when(no % 19 == 0, " A_f-X ").otherwise(F.col("transaction_type"))})


def _typed(spark, sf_dir):
    return dirty_landing(spark, sf_dir).withColumns({
        "quantity_consumed": P.to_number(F.col("quantity_consumed")),
        "transaction_time": P.to_timestamp_lenient(F.col("transaction_time"))})


@register("d14_dirty_checkpoint", sql=f"""WITH {_DIRTY_SQL},
u AS (SELECT *, count(*) OVER (PARTITION BY transaction_id) > 1 AS again FROM typed)
SELECT 'transaction_id_not_null' AS rule, count(*) AS element_count, CAST(count_if(transaction_id IS NULL) AS BIGINT) AS unexpected_count FROM u
UNION ALL SELECT 'transaction_time_not_null', count(*), CAST(count_if(transaction_time IS NULL) AS BIGINT) FROM u
UNION ALL SELECT 'sku_id_not_null', count(*), CAST(count_if(sku_id IS NULL) AS BIGINT) FROM u
UNION ALL SELECT 'transaction_id_unique', count(transaction_id), CAST(count_if(again) AS BIGINT) FROM u
UNION ALL SELECT 'quantity_consumed_between', count(quantity_consumed), CAST(count_if(quantity_consumed < 0) AS BIGINT) FROM u
UNION ALL SELECT 'table_columns_match_set', {len(rules.TRANSACTION_COLUMNS)}, 0""")
def dirty_checkpoint(spark, sf_dir):
    """The transactions checkpoint over rows with faults of every kind."""
    _, _, results, _ = rules.run_checkpoint(_typed(spark, sf_dir), "transactions_checkpoint")
    return results.select("rule", "element_count", "unexpected_count")


@register("d6_dirty_passed", sql=f"""WITH {_DIRTY_SQL},
u AS (SELECT *, count(*) OVER (PARTITION BY transaction_id) > 1 AS again FROM typed)
SELECT transaction_id, sku_id, transaction_time, quantity_consumed FROM u
WHERE transaction_id IS NOT NULL AND sku_id IS NOT NULL AND transaction_time IS NOT NULL AND NOT again
  AND coalesce(quantity_consumed >= 0, true)""")
def dirty_passed(spark, sf_dir):
    """Rows that fail no rule, from the annotated rows written once by outcome."""
    path = scratch_path(spark, f"checked/{uuid.uuid4().hex}")
    delete_at_end(spark, path)
    rules.write_split(_typed(spark, sf_dir), rules.TRANSACTIONS_SUITE, path)
    passed, _ = rules.read_split(spark, path)
    return passed.select("transaction_id", "sku_id", "transaction_time", "quantity_consumed")


@register("d1_dirty_clean", sql=f"""WITH {_DIRTY_SQL}
SELECT transaction_id, sku_id, transaction_time, quantity_consumed,
       lower(translate(trim(transaction_type), '_-', '  ')) AS transaction_type
FROM typed WHERE quantity_consumed >= 0""")
def dirty_clean(spark, sf_dir):
    """Cleaning of unparseable numbers and dates, negatives and odd text."""
    return cleaning.clean_transactions(dirty_landing(spark, sf_dir)).select(
        "transaction_id", "sku_id", "transaction_time", "quantity_consumed", "transaction_type")


_FILLED = sorted(P.SKU_FILLS)
_SENTINEL_SQL = "['" + "', '".join(P.SENTINELS) + "']"


@register("j12_fill_skus", sql=f"""
WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS sku_name,
                  CASE WHEN p_partkey % 3 = 0 THEN {_SENTINEL_SQL}[CAST(p_partkey // 3 % {len(P.SENTINELS)} AS INTEGER) + 1]
                       WHEN p_partkey % 3 = 1 THEN p_type END AS v FROM part)
SELECT sku_id, sku_name, {', '.join(f"coalesce(CASE WHEN v NOT IN ('" + "', '".join(P.SENTINELS) + f"') THEN v END, '{P.SKU_FILLS[c]}') AS {c}" for c in _FILLED)}
FROM s""")
def fill_skus(spark, sf_dir):
    """Sentinels become missing and missing values of the four filled columns their constant."""
    no = F.col("sku_id").cast("bigint")
    bad = F.element_at(F.array(*[F.lit(x) for x in P.SENTINELS]), ((F.floor(no / 3) % len(P.SENTINELS)) + 1).cast("int"))
    v = F.when(no % 3 == 0, bad).when(no % 3 == 1, F.col("category"))
    src = sku_master(spark, sf_dir).withColumns({c: v for c in _FILLED})
    return cleaning.clean_sku_master(src).select("sku_id", "sku_name", *_FILLED)


@register("a1_sku_csv_roundtrip", sql="""
SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS sku_name, p_type AS category, CAST(p_size AS VARCHAR) AS _size FROM part""")
def sku_csv(spark, sf_dir):
    """SKU-master CSV with untidy headers, read as text, names normalised."""
    src = sku_master(spark, sf_dir).select(F.col("sku_id").alias("SKU ID"), F.col("sku_name").alias("Sku-Name"),
                                           F.col("category").alias("CATEGORY"), F.col("minimum_order_quantity").alias(" Size"))
    path = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    delete_at_end(spark, path)
    src.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return landing.read_csv_landing(spark, path, required=["sku_id"])


@register("a3_fallback_source", sql="SELECT n_nationkey, n_name, n_regionkey, 0 AS optional_rows FROM nation")
def fallback_source(spark, sf_dir):
    """A3 / A10: the first source that resolves is read; a missing optional CSV is empty."""
    df = io.first_resolving(spark, [{"path": table_path(sf_dir, "no_such_table")}, {"path": table_path(sf_dir, "nation")}])
    missing = io.read_csv(spark, f"{sf_dir}/no_such_file.csv", df.schema)
    return df.select("n_nationkey", "n_name", "n_regionkey", F.lit(len(missing.take(1))).alias("optional_rows"))


@register("a9_table_source", sql="""
WITH e AS (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-20 00:00:00' AS event_timestamp, c_custkey % 2 AS label FROM customer),
f AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT e.user_id, e.event_timestamp, e.label, CASE WHEN f.ts >= e.event_timestamp - INTERVAL 6 HOUR THEN f.value END AS value
FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.event_timestamp >= f.ts""")
def table_source(spark, sf_dir):
    """A feature view over a named table, asked for literal entity
    rows (keys, one timestamp, a label)."""
    name = f"feature_rows_{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").createOrReplaceTempView(name)
    view = fv.FeatureView("rows", fv.Entity("user", "user_id"), spark.table(name), "ts", {"value": "double"},
                          ttl_seconds=6 * 3600, created_field="event_id")
    entities = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("event_timestamp"),
        (F.col("c_custkey") % 2).alias("label"))
    return fv.FeatureRegistry().apply(view).historical(entities, ["rows:value"], bucket_seconds=3600)


@register("d8_key_equality", sql="""
SELECT l_orderkey AS "order key", l_partkey, date_trunc('second', l_shipdate) AS day
FROM lineitem WHERE l_partkey = 42""")
def key_equality(spark, sf_dir):
    """Equality on a key reaches the scan; zone-free times; the first
    candidate date column; names normalised as in the validation step."""
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_partkey") == 42).select(
        F.col("l_orderkey").alias("Order Key"), "l_partkey", F.col("l_shipdate").cast("timestamp").alias("day"))
    li = cleaning.rename(cleaning.strip_zone(li), lambda c: P.sanitize_validation_name(c, dash=True))
    day = cleaning.pick_date_column(li)
    return li.select(F.col("order_key").alias("order key"), "l_partkey", F.col(day).alias("day"))


@register("c9_integer_keys", sql="""
SELECT TRY_CAST(CASE WHEN l_partkey % 7 = 0 THEN 'P' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS BIGINT) AS sku_id, count(*) AS rows
FROM lineitem GROUP BY 1""")
def integer_keys(spark, sf_dir):
    """Text keys as integers; a key that is none (every seventh part's, made so here) is missing."""
    part = F.col("l_partkey")
    text = F.when(part % 7 == 0, F.concat(F.lit("P"), part.cast("string"))).otherwise(part.cast("string"))
    return (read_table(spark, sf_dir, "lineitem").select(P.to_key(text).alias("sku_id"))
            .groupBy("sku_id").agg(F.count(F.lit(1)).alias("rows")))
