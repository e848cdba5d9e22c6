"""Quality queries: rules, cleaning, landing loads, profiling and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockpulse.functions.parsing import to_number
from stockpulse.operators import cleaning, landing, profile, rules
from stockpulse.plans.registry import register
from stockpulse.sources.tables import TX_SQL, landing_transactions, read_table, sku_master

# --------------------------------------------------------------------- rules

_LANDING_SQL = TX_SQL + """,
landing AS (
  SELECT transaction_id, transaction_code, hospital_id, CAST(NULL AS VARCHAR) AS dept_id,
         CAST(NULL AS VARCHAR) AS physician_id, CAST(NULL AS VARCHAR) AS patient_id,
         CAST(NULL AS VARCHAR) AS prescription_id, CAST(NULL AS VARCHAR) AS prescription_detail_id,
         CAST(NULL AS VARCHAR) AS bill_id, CAST(NULL AS VARCHAR) AS procedure_id, sku_id, transaction_time,
         CAST(quantity_consumed AS VARCHAR) AS quantity_consumed, CAST(NULL AS VARCHAR) AS unit_cogs,
         CAST(NULL AS VARCHAR) AS unit_price, CAST(NULL AS VARCHAR) AS margin_amount,
         CAST(NULL AS VARCHAR) AS margin_percentage, CAST(total_revenue AS VARCHAR) AS total_revenue,
         transaction_type, CAST(NULL AS VARCHAR) AS last_updated
  FROM transactions
)"""

# Rules run on typed values (quantity parsed), as a typed landing would hold.
_TYPED_SQL = _LANDING_SQL + """,
typed AS (
  SELECT * REPLACE (TRY_CAST(quantity_consumed AS DOUBLE) AS quantity_consumed) FROM landing
),
dups AS (
  SELECT transaction_id FROM typed WHERE transaction_id IS NOT NULL
  GROUP BY transaction_id HAVING count(*) > 1
),
flagged AS (
  SELECT t.*,
    concat_ws(',',
      CASE WHEN t.transaction_id IS NULL THEN 'transaction_id_not_null' END,
      CASE WHEN t.transaction_time IS NULL THEN 'transaction_time_not_null' END,
      CASE WHEN t.sku_id IS NULL THEN 'sku_id_not_null' END,
      CASE WHEN d.transaction_id IS NOT NULL THEN 'transaction_id_unique' END,
      CASE WHEN t.quantity_consumed IS NOT NULL AND (t.quantity_consumed < 0 OR isnan(t.quantity_consumed))
           THEN 'quantity_consumed_between' END) AS failed_rules
  FROM typed t LEFT JOIN dups d ON t.transaction_id = d.transaction_id
)"""


def _typed_landing(spark, sf_dir):
    lt = landing_transactions(spark, sf_dir)
    return lt.withColumn("quantity_consumed", to_number(F.col("quantity_consumed")))


@register("d6_rule_rejects", sql=f"""WITH {_TYPED_SQL}
SELECT transaction_id, sku_id, transaction_time, quantity_consumed, failed_rules
FROM flagged WHERE failed_rules <> ''""")
def rule_rejects(spark, sf_dir):
    """Rejected rows with the names of the rules they fail."""
    _, rejected = rules.split(_typed_landing(spark, sf_dir), rules.TRANSACTIONS_SUITE)
    return rejected.select("transaction_id", "sku_id", "transaction_time", "quantity_consumed",
                           F.array_join("failed_rules", ",").alias("failed_rules"))


@register("d6_rule_passed", sql=f"""WITH {_TYPED_SQL}
SELECT transaction_id, sku_id, transaction_time, quantity_consumed, total_revenue
FROM flagged WHERE failed_rules = ''""")
def rule_passed(spark, sf_dir):
    """Rows that fail no rule."""
    passed, _ = rules.split(_typed_landing(spark, sf_dir), rules.TRANSACTIONS_SUITE)
    return passed.select("transaction_id", "sku_id", "transaction_time", "quantity_consumed", "total_revenue")


@register("f12_split_counts", sql=f"""WITH {_TYPED_SQL}
SELECT CAST(count_if(failed_rules = '') AS BIGINT) AS passed, CAST(count_if(failed_rules <> '') AS BIGINT) AS failed,
       count(*) AS loaded FROM flagged""")
def split_counts(spark, sf_dir):
    """passed / failed / loaded row counts of one rule run."""
    ann = rules.annotate(_typed_landing(spark, sf_dir), rules.TRANSACTIONS_SUITE)
    return ann.agg(F.count_if(F.size("failed_rules") == 0).alias("passed"),
                   F.count_if(F.size("failed_rules") > 0).alias("failed"),
                   F.count(F.lit(1)).alias("loaded"))


@register("d7_rule_results", sql=f"""WITH {_TYPED_SQL},
agg AS (
  SELECT count(*) AS n, count(transaction_id) AS nn_id, count(quantity_consumed) AS nn_q,
    count_if(transaction_id IS NULL) AS v_id, count_if(transaction_time IS NULL) AS v_time,
    count_if(sku_id IS NULL) AS v_sku, count_if(failed_rules LIKE '%transaction_id_unique%') AS v_uniq,
    count_if(failed_rules LIKE '%quantity_consumed_between%') AS v_q
  FROM flagged),
r AS (
  SELECT 'transaction_id_not_null' AS rule, 'transaction_id' AS column_name, n AS element_count, v_id AS unexpected_count FROM agg
  UNION ALL SELECT 'transaction_time_not_null', 'transaction_time', n, v_time FROM agg
  UNION ALL SELECT 'sku_id_not_null', 'sku_id', n, v_sku FROM agg
  UNION ALL SELECT 'transaction_id_unique', 'transaction_id', nn_id, v_uniq FROM agg
  UNION ALL SELECT 'quantity_consumed_between', 'quantity_consumed', nn_q, v_q FROM agg
  UNION ALL SELECT 'table_columns_match_set', CAST(NULL AS VARCHAR), CAST(20 AS BIGINT), CAST(0 AS BIGINT) FROM agg)
SELECT rule, column_name, CAST(element_count AS BIGINT) AS element_count, CAST(unexpected_count AS BIGINT) AS unexpected_count,
  CASE WHEN element_count > 0 THEN CAST(unexpected_count AS DOUBLE) * 100.0 / element_count ELSE 0.0 END AS unexpected_percent,
  (CASE WHEN element_count > 0 THEN CAST(unexpected_count AS DOUBLE) * 100.0 / element_count ELSE 0.0 END) <= 1e-12 AS success
FROM r""")
def rule_results(spark, sf_dir):
    """Per-rule success and unexpected counts (one aggregate), plus
    the dataset-level column-set rule."""
    return rules.results(_typed_landing(spark, sf_dir), rules.TRANSACTIONS_SUITE)


@register("d7_sku_rule_results", sql="""
WITH agg AS (SELECT count(*) AS n, count(p_partkey) AS nn,
               count_if(p_partkey IS NULL) AS v_id, count_if(p_name IS NULL) AS v_name,
               count(p_partkey) - (SELECT count(*) FROM (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL
                                    GROUP BY p_partkey HAVING count(*) = 1)) AS v_uniq
             FROM part),
r AS (SELECT 'sku_id_not_null' AS rule, 'sku_id' AS column_name, n AS element_count, v_id AS unexpected_count FROM agg
      UNION ALL SELECT 'sku_name_not_null', 'sku_name', n, v_name FROM agg
      UNION ALL SELECT 'sku_id_unique', 'sku_id', nn, v_uniq FROM agg
      UNION ALL SELECT 'table_columns_match_set', CAST(NULL AS VARCHAR), CAST(23 AS BIGINT), CAST(0 AS BIGINT) FROM agg)
SELECT rule, column_name, CAST(element_count AS BIGINT) AS element_count, CAST(unexpected_count AS BIGINT) AS unexpected_count,
  CASE WHEN element_count > 0 THEN CAST(unexpected_count AS DOUBLE) * 100.0 / element_count ELSE 0.0 END AS unexpected_percent,
  (CASE WHEN element_count > 0 THEN CAST(unexpected_count AS DOUBLE) * 100.0 / element_count ELSE 0.0 END) <= 1e-12 AS success
FROM r""")
def sku_rule_results(spark, sf_dir):
    """The SKU checkpoint's per-rule results over the SKU master."""
    return rules.results(sku_master(spark, sf_dir), rules.SKU_SUITE)


# ------------------------------------------------------------------ cleaning

@register("d1_clean_transactions", sql=f"""WITH {_LANDING_SQL}
SELECT transaction_id,
  lower(translate(trim(transaction_code), '_-', '  ')) AS transaction_code,
  hospital_id, dept_id, patient_id, sku_id, transaction_time,
  q AS quantity_consumed, CAST(NULL AS DOUBLE) AS unit_cogs, CAST(NULL AS DOUBLE) AS unit_price,
  CAST(NULL AS DOUBLE) AS margin_amount, CAST(NULL AS DOUBLE) AS margin_percentage,
  TRY_CAST(total_revenue AS DOUBLE) AS total_revenue,
  lower(translate(trim(transaction_type), '_-', '  ')) AS transaction_type,
  CAST(NULL AS TIMESTAMP) AS last_updated
FROM (SELECT *, TRY_CAST(quantity_consumed AS DOUBLE) AS q FROM landing)
WHERE q >= 0 AND NOT isnan(q)""")
def clean_transactions(spark, sf_dir):
    """Landing text -> clean typed transactions."""
    return cleaning.clean_transactions(landing_transactions(spark, sf_dir))


_SENT = "('nan', 'NaN', 'NULL', 'None', '', 'unknown', 'Unknown')"


def _sent(c):
    return f"CASE WHEN {c} IN {_SENT} THEN NULL ELSE {c} END AS {c}"


@register("c4_clean_sku_master", sql=f"""
WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_brand AS sku_code, p_name AS sku_name,
                  p_type AS category, 'unit' AS unit_of_measure, CAST(p_retailprice AS VARCHAR) AS standard_cost,
                  CAST(p_size AS VARCHAR) AS minimum_order_quantity FROM part)
SELECT {', '.join(_sent(c) for c in ['sku_id', 'sku_code', 'sku_name', 'category', 'unit_of_measure',
                                      'standard_cost', 'minimum_order_quantity'])}
FROM s""")
def clean_skus(spark, sf_dir):
    """SKU master cleaning (all-null columns dropped, so the
    fills for absent columns are skipped)."""
    return cleaning.clean_sku_master(sku_master(spark, sf_dir))


@register("f5_null_counts", sql=f"""WITH {_LANDING_SQL}
SELECT column_name, null_count FROM (
  SELECT {', '.join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}" for c in rules.TRANSACTION_COLUMNS)} FROM landing
) UNPIVOT (null_count FOR column_name IN ({', '.join(rules.TRANSACTION_COLUMNS)}))""")
def null_counts(spark, sf_dir):
    """null count per landing column."""
    return cleaning.null_counts(landing_transactions(spark, sf_dir))


# ------------------------------------------------------------------- landing

_HASH_COLS = list(rules.TRANSACTION_COLUMNS)


@register("b2_landing_load", sql=f"""WITH {_LANDING_SQL}
SELECT DISTINCT *, md5(concat_ws('||', {', '.join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in _HASH_COLS)})) AS row_hash
FROM landing""")
def landing_load(spark, sf_dir):
    """Row hash + dedup on (row_hash, transaction_time)."""
    return landing.load_transactions(landing_transactions(spark, sf_dir))


@register("b1_keyed_load_skus", sql="""
SELECT sku_id, arg_min(sku_name, pos) AS sku_name, arg_min(sku_code, pos) AS sku_code
FROM (SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS sku_name, p_brand AS sku_code,
             p_partkey AS pos FROM part)
GROUP BY sku_id""")
def keyed_load_skus(spark, sf_dir):
    """B1: keyed load of the SKU master, first copy of a key wins."""
    s = sku_master(spark, sf_dir).select("sku_id", "sku_name", "sku_code",
                                         F.col("sku_id").cast("bigint").alias("pos"))
    return landing.keyed_first_wins(s, ["sku_id"], "pos").drop("pos")


@register("b1_first_part_per_brand", sql="""
SELECT p_brand AS sku_code, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name
FROM part GROUP BY p_brand""")
def first_part_per_brand(spark, sf_dir):
    """B1 / I5 with real repeats: key = brand, position = part key."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("sku_code"), "p_partkey", "p_name",
                                                 F.col("p_partkey").alias("pos"))
    return landing.keyed_first_wins(p, ["sku_code"], "pos").drop("pos")


# ----------------------------------------------------------------- profiling

_PROFILE_TEXT = ["transaction_id", "transaction_code", "hospital_id", "sku_id", "transaction_type"]
_PROFILE_NUM = ["quantity_consumed", "total_revenue"]


def _profile_sql(table, texts, nums, quartiles, times=()):
    """Twin of `describe`: times are shown as text in Spark's form."""
    text = [(c, f"CAST({c} AS VARCHAR)") for c in [*texts, *times]]
    vc = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {e} AS value FROM {table} WHERE {c} IS NOT NULL" for c, e in text)
    q = ", ".join(f"round(quantile_cont(CAST({{c}} AS DOUBLE), {x}), 6) AS q{int(100 * x)}" for x in (0.25, 0.5, 0.75))
    num = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
        f"CAST(NULL AS BIGINT) AS freq, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, {q.format(c=c) + ',' if quartiles else ''} CAST(max({c}) AS DOUBLE) AS max FROM {table}"
        for c in nums)
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in
                      ["mean", "std", "min", *(["q25", "q50", "q75"] if quartiles else []), "max"])
    return f"""
vc AS (SELECT column_name, value, count(*) AS cnt FROM ({vc}) GROUP BY 1, 2)
SELECT column_name, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS "unique", arg_min(value, (-cnt, value)) AS top,
       max(cnt) AS freq, {nulls} FROM vc GROUP BY 1
UNION ALL {num}"""


def _rounded(d):
    return d.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else F.col(c) for c in d.columns])


@register("f6_describe", sql=f"WITH {TX_SQL}," + _profile_sql("transactions", _PROFILE_TEXT, _PROFILE_NUM, False, ["transaction_time"]))
def describe(spark, sf_dir):
    """profile of every transaction column (count, unique, top, freq, mean, std, min, max)."""
    from stockpulse.sources.tables import transactions
    return _rounded(profile.describe(transactions(spark, sf_dir).drop("revenue_units")))


_LINE_TEXT = ["l_returnflag", "l_linestatus"]
_LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("f6_describe_quartiles", sql="WITH " + _profile_sql("lineitem", _LINE_TEXT, _LINE_NUM, True, ["l_shipdate"]))
def describe_quartiles(spark, sf_dir):
    """F6 with exact quartiles over every lineitem column."""
    return _rounded(profile.describe(read_table(spark, sf_dir, "lineitem"), quartiles=True))


@register("f16_quality_summary", sql=f"""WITH {_LANDING_SQL},
u AS (SELECT {', '.join(f'count(DISTINCT {c}) AS {c}' for c in rules.TRANSACTION_COLUMNS)} FROM landing)
SELECT (SELECT count(*) FROM landing) AS rows, {len(rules.TRANSACTION_COLUMNS)} AS columns,
  (SELECT CAST({' + '.join(f'count_if({c} IS NULL)' for c in rules.TRANSACTION_COLUMNS)} AS BIGINT) FROM landing) AS missing_cells,
  (SELECT {' + '.join(f'CAST({c} = 1 AS BIGINT)' for c in rules.TRANSACTION_COLUMNS)} FROM u) AS constant_columns,
  (SELECT count(*) FROM landing) - (SELECT count(*) FROM (SELECT DISTINCT * FROM landing)) AS duplicated_rows""")
def quality_summary(spark, sf_dir):
    """F16: data quality summary of the landing table."""
    return profile.quality_summary(landing_transactions(spark, sf_dir))


_DRIFT_SPLIT = "TIMESTAMP '1998-06-01 00:00:00'"
_DRIFT_NUM = _LINE_NUM
_DRIFT_CAT = _LINE_TEXT


def _drift_sql():
    def side(c, flag, cmp):
        return f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x, {flag} AS is_ref FROM lineitem WHERE l_shipdate {cmp} {_DRIFT_SPLIT} AND {c} IS NOT NULL"
    num = " UNION ALL ".join(side(c, 1, "<") + " UNION ALL " + side(c, 0, ">=") for c in _DRIFT_NUM)

    def cside(c, cmp):
        return f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM lineitem WHERE l_shipdate {cmp} {_DRIFT_SPLIT} AND {c} IS NOT NULL"
    cref = " UNION ALL ".join(cside(c, "<") for c in _DRIFT_CAT)
    ccur = " UNION ALL ".join(cside(c, ">=") for c in _DRIFT_CAT)
    std = " UNION ALL ".join(f"SELECT '{c}' AS column_name, stddev_pop(CAST({c} AS DOUBLE)) AS std_ref FROM lineitem WHERE l_shipdate < {_DRIFT_SPLIT}" for c in _DRIFT_NUM)
    return f"""WITH b AS ({num}),
cnt AS (SELECT column_name, x, count_if(is_ref = 1) AS n_ref, count_if(is_ref = 0) AS n_cur FROM b GROUP BY 1, 2),
tot AS (SELECT column_name, sum(n_ref) AS t_ref, sum(n_cur) AS t_cur FROM cnt GROUP BY 1),
cum AS (SELECT c.column_name, c.x,
          sum(n_ref) OVER (PARTITION BY c.column_name ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
          sum(n_cur) OVER (PARTITION BY c.column_name ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
          lead(x) OVER (PARTITION BY c.column_name ORDER BY x) AS nx
        FROM cnt c),
per AS (SELECT cum.column_name, abs(cr / t_ref - cc / t_cur) AS d,
               abs(cr / t_ref - cc / t_cur) * coalesce(nx - x, 0.0) AS area
        FROM cum JOIN tot USING (column_name)),
std AS ({std}),
numr AS (SELECT column_name, 'numeric' AS kind, round(sum(area) / greatest(max(std_ref), 0.001), 9) AS drift_score,
                round(max(d), 9) AS ks_statistic, CAST(0.1 AS DOUBLE) AS threshold
         FROM per JOIN std USING (column_name) GROUP BY column_name),
r AS (SELECT column_name, value, count(*) AS n_ref FROM ({cref}) GROUP BY 1, 2),
c AS (SELECT column_name, value, count(*) AS n_cur FROM ({ccur}) GROUP BY 1, 2),
j AS (SELECT coalesce(r.column_name, c.column_name) AS column_name, coalesce(n_ref, 0) AS n_ref, coalesce(n_cur, 0) AS n_cur
      FROM r FULL JOIN c ON r.column_name = c.column_name AND r.value = c.value),
jt AS (SELECT j.*, sum(n_ref) OVER (PARTITION BY column_name) AS t_ref, sum(n_cur) OVER (PARTITION BY column_name) AS t_cur FROM j),
pq AS (SELECT column_name, CAST(n_ref AS DOUBLE) / t_ref AS p, CAST(n_cur AS DOUBLE) / t_cur AS q FROM jt),
catr AS (SELECT column_name, 'categorical' AS kind,
           round(sqrt(greatest((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
                      + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)), 9) AS drift_score,
           CAST(NULL AS DOUBLE) AS ks_statistic, CAST(0.1 AS DOUBLE) AS threshold FROM pq GROUP BY column_name),
rep AS (SELECT * FROM numr UNION ALL SELECT * FROM catr),
rep2 AS (SELECT *, drift_score >= threshold AS drifted FROM rep)
SELECT rep2.*, s.drift_share, s.drift_share >= 0.5 AS dataset_drift
FROM rep2, (SELECT CAST(count_if(drifted) AS DOUBLE) / count(*) AS drift_share FROM rep2) s"""


@register("f15_drift", sql=_drift_sql())
def drift(spark, sf_dir):
    """Drift of the lineitem columns, shipments before vs after
    1998-06-01 (the split column itself left out); both sides from one scan."""
    li = read_table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    both = li.withColumn("is_ref", F.col("l_shipdate") < F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))
    rep = profile.drift_of(both, _DRIFT_NUM, _DRIFT_CAT)
    return (rep.withColumn("drift_score", F.round("drift_score", 9))
            .withColumn("ks_statistic", F.round("ks_statistic", 9)))


_SMALL_DRIFT_SQL = """WITH b AS (
  SELECT s_acctbal AS acctbal, n_regionkey AS regionkey, n_name AS nation, true AS is_ref FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT c_acctbal, n_regionkey, n_name, false FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT 'acctbal' AS column_name, CAST(acctbal AS DOUBLE) AS x, NULL AS value, is_ref FROM b
      UNION ALL SELECT 'regionkey', CAST(regionkey AS DOUBLE), NULL, is_ref FROM b
      UNION ALL SELECT 'nation', NULL, nation, is_ref FROM b),
c AS (SELECT column_name, x, value, count_if(is_ref) AS n_ref, count_if(NOT is_ref) AS n_cur FROM v
      WHERE x IS NOT NULL OR value IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n_ref) OVER w AS t_ref, sum(n_cur) OVER w AS t_cur,
             sum(n_ref) OVER o AS c_ref, sum(n_cur) OVER o AS c_cur FROM c
      WINDOW w AS (PARTITION BY column_name), o AS (PARTITION BY column_name ORDER BY x, value ROWS UNBOUNDED PRECEDING)),
s AS (SELECT column_name, CASE WHEN column_name = 'nation' THEN 'categorical' ELSE 'numeric' END AS kind,
             CASE WHEN column_name = 'nation' OR count_if(n_ref > 0) <= 5 THEN 'chi_square' ELSE 'ks' END AS test,
             max(abs(c_ref / t_ref - c_cur / t_cur)) AS ks, max(t_ref) AS n, max(t_cur) AS m, count(*) - 1 AS df,
             sum(CASE WHEN n_ref > 0 THEN (n_cur - n_ref * t_cur / t_ref) ** 2 / (n_ref * t_cur / t_ref) ELSE 'inf'::DOUBLE END) AS chi
      FROM t GROUP BY column_name),
p AS (SELECT column_name, kind, test, CASE WHEN test = 'ks' THEN ks ELSE chi END AS statistic,
             CASE WHEN test = 'ks' THEN (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * n * m / (n + m) * ks * ks))
                                         FROM range(1, 200) r(k))
                  WHEN chi = 'inf'::DOUBLE THEN 0
                  -- the lower function as a sum over Gamma
                  ELSE 1 - (SELECT sum(exp(-chi / 2 + (df / 2 + k) * ln(chi / 2) - lgamma(df / 2 + k + 1))) FROM range(0, 2000) r(k)) END AS p
      FROM s),
r AS (SELECT column_name, kind, test, round(statistic, 6) AS statistic, round(greatest(least(p, 1), 0), 6) AS drift_score,
             CAST(0.05 AS DOUBLE) AS threshold, p < 0.05 AS drifted FROM p)
SELECT r.*, d.share AS drift_share, d.share >= 0.5 AS dataset_drift
FROM r, (SELECT CAST(count_if(drifted) AS DOUBLE) / count(*) AS share FROM r) d"""


@register("f15_drift_small_reference", sql=_SMALL_DRIFT_SQL)
def drift_small_reference(spark, sf_dir):
    """F15, small references: p-values of the suppliers' balance, nation and region against the customers'
    (KS; chi-square; chi-square of a numeric column with few values)."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("regionkey"), F.col("n_name").alias("nation"))

    def side(table, prefix):
        t = read_table(spark, sf_dir, table).select(F.col(f"{prefix}_acctbal").alias("acctbal"), F.col(f"{prefix}_nationkey").alias("n_nationkey"))
        return t.join(nation, "n_nationkey").select("acctbal", "regionkey", "nation")
    both = side("supplier", "s").withColumn("is_ref", F.lit(True)).unionByName(
        side("customer", "c").withColumn("is_ref", F.lit(False)))
    rep = profile.p_value_drift(both, ["acctbal", "regionkey"], ["nation"])
    return rep.withColumn("statistic", F.round("statistic", 6)).withColumn("drift_score", F.round("drift_score", 6))


@register("b2_partitioned_landing_roundtrip", sql=f"""WITH {_LANDING_SQL}
SELECT DISTINCT *, md5(concat_ws('||', {', '.join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in _HASH_COLS)})) AS row_hash,
       strftime(transaction_time, '%Y-%m') AS tx_month
FROM landing""")
def partitioned_landing_roundtrip(spark, sf_dir):
    """Landing load written time-partitioned by month (the
    hypertable analogue), read back (partition column restored as text)."""
    from stockpulse.session import run_folder
    from stockpulse.sources import io
    df = landing.load_transactions(landing_transactions(spark, sf_dir)).withColumn(
        "tx_month", F.date_format("transaction_time", "yyyy-MM"))
    path = run_folder(spark, "roundtrip/landing")
    io.write_table(df, path, partition_by=["tx_month"])
    back = spark.read.option("basePath", path).schema(df.schema).parquet(path)
    return back.select(*df.columns)


@register("b2_month_reload", sql=f"""WITH {_LANDING_SQL},
once AS (SELECT DISTINCT *, strftime(transaction_time, '%Y-%m') AS tx_month FROM landing),
now AS (SELECT * REPLACE (CASE WHEN tx_month LIKE '1995-%' THEN 'corrected' ELSE transaction_type END AS transaction_type) FROM once)
SELECT tx_month, transaction_type, count(*) AS rows, count(DISTINCT sku_id) AS skus FROM now GROUP BY 1, 2""")
def month_reload(spark, sf_dir):
    """The landing load by month, then the months of 1995 loaded again with corrected rows: only
    their folders are replaced. Counted per month and type from the reread table."""
    from stockpulse.session import run_folder
    from stockpulse.sources import zones
    df = landing.load_transactions(landing_transactions(spark, sf_dir)).withColumn(
        "tx_month", F.date_format("transaction_time", "yyyy-MM"))
    path = run_folder(spark, "roundtrip/months")
    zones.reload_partitions(df, path, "tx_month")
    corrected = zones.read_partitions(spark, path, df.schema).where(F.col("tx_month").between("1995-01", "1995-12"))
    zones.reload_partitions(corrected.withColumn("transaction_type", F.lit("corrected")), path, "tx_month")
    return zones.read_partitions(spark, path, df.schema).groupBy("tx_month", "transaction_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sku_id").alias("skus"))


@register("b5_rejects_roundtrip", sql=f"""WITH {_TYPED_SQL}
SELECT transaction_id, sku_id, transaction_time, quantity_consumed, failed_rules
FROM flagged WHERE failed_rules <> ''""")
def rejects_roundtrip(spark, sf_dir):
    """Reject table written only when non-empty, read back."""
    from stockpulse.session import run_folder
    from stockpulse.sources import io
    rej = rule_rejects(spark, sf_dir)
    path = run_folder(spark, "roundtrip/rejects")
    if not io.write_if_rows(rej, path):
        return rej
    return spark.read.parquet(path)


@register("a2_csv_ingest_roundtrip", sql=f"""WITH {_LANDING_SQL}
SELECT transaction_id, transaction_code, hospital_id, sku_id, transaction_time, quantity_consumed,
       total_revenue, transaction_type FROM landing""")
def csv_ingest_roundtrip(spark, sf_dir):
    """Landing rows exported as a CSV with display-style
    headers, then ingested as text with a required-column check, names
    normalised and the time column parsed."""
    from stockpulse.session import run_folder
    from stockpulse.sources import io
    cols = ["transaction_id", "transaction_code", "hospital_id", "sku_id", "transaction_time",
            "quantity_consumed", "total_revenue", "transaction_type"]
    src = landing_transactions(spark, sf_dir).select(*cols)
    shown = src.select(*[F.col(c).alias(c.replace("_", " ").title()) for c in cols])
    path = run_folder(spark, "roundtrip/csv_ingest")
    io.write_csv(shown.withColumn("Transaction Time",
                                  F.date_format("Transaction Time", "yyyy-MM-dd HH:mm:ss")), path)
    back = landing.read_csv_landing(spark, path, required=["transaction_time"])
    return back.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "transaction_time" else c
                         for c in cols])


@register("a6_describe_schema", sql="""
SELECT column_name,
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                        WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                        ELSE lower(column_type) END AS data_type,
       "null" = 'YES' AS nullable
FROM (DESCRIBE lineitem)""")
def describe_lineitem(spark, sf_dir):
    """Schema introspection (column, type, nullable) of a source table."""
    from stockpulse.sources import io
    return io.describe_schema(read_table(spark, sf_dir, "lineitem"))
