"""Readers for the given parquet tables and the adapters that turn the
TPC-H-like star schema into the demand model (transactions, SKU master).

Mapping (one transaction per line item):
  transaction_id    = l_orderkey * 10 + l_linenumber  (repeats; the uniqueness rule has work)
  sku_id            = p_brand      (demand series)    | l_partkey for the wide-key variant
  hospital_id       = n_regionkey via supplier -> nation, as text
  transaction_time  = l_shipdate
  quantity_consumed = l_quantity
  total_revenue     = l_extendedprice * (1 - l_discount), exact DECIMAL(18,4)
  transaction_type  = l_returnflag || '_' || l_linestatus

Join strategy: no hints. Spark broadcasts a dimension whose measured size is under
`spark.sql.autoBroadcastJoinThreshold`, at run time too, and otherwise sorts and
merges, splitting skewed partitions (a part or supplier may carry a third of the line
items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def stream_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Path of a table for `readStream`: a folder of part files as it is; a
    single file as a pattern that only it matches, as streams list folders or patterns."""
    path = table_path(sf_dir, name)
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path
    return f"{path[:-1]}[{path[-1]}]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def input_state(spark: SparkSession, sf_dir: str, names) -> str:
    """Text that changes when a file of these tables comes, goes, grows or is written
    anew. Spark lists the files, in subfolders too, and reads none of them."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load([table_path(sf_dir, n) for n in names]))
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    seen = files.agg(F.count(F.lit(1)).alias("files"), F.sum(one).alias("hash")).first()
    return f"{seen['files']}:{seen['hash']}"


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views for `spark.sql` access (A5: query text -> DataFrame)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def revenue_expr(price: Column, discount: Column) -> Column:
    """extendedprice * (1 - discount), exact in DECIMAL(18,4)."""
    p = price.cast("decimal(18,2)")
    d = discount.cast("decimal(18,2)")
    return (p * (F.lit(1).cast("decimal(18,2)") - d)).cast("decimal(18,4)")


REVENUE_SCALE = 10_000   # revenue units: 1e-4 of the currency


def revenue_units_expr(price: Column, discount: Column) -> Column:
    """The same revenue as `revenue_expr`, as an exact long count of 1e-4
    units (cents x percent). Sums of longs stay on the fast codegen path;
    DECIMAL(38,4) products and sums go through BigDecimal per row."""
    cents = F.round(price * 100).cast("long")
    pct = F.round(discount * 100).cast("long")
    return cents * (F.lit(100) - pct)


def supplier_hospital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> hospital_id (region key as text)."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    out = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
           .select("s_suppkey", F.col("n_regionkey").cast("string").alias("hospital_id")))
    return out


def margin_percentage(revenue: Column, quantity: Column, unit_cogs: Column) -> Column:
    """Margin in percent of revenue; NULL without revenue."""
    r = revenue.cast("double")
    return F.when(r != 0, (r - quantity * unit_cogs) / r * 100)


def transactions(spark: SparkSession, sf_dir: str, sku: str = "brand", margins: bool = False) -> DataFrame:
    """Typed transactions view (clean-zone shape) built from lineitem.

    sku="brand" gives 25 x 5 dense daily series; sku="part" keys by part.
    Only the columns a query selects survive Catalyst's pruning, so a
    2-column consumer reads 2-3 lineitem columns from parquet. margins adds unit_cogs
    (the part's retail price), unit_price, margin_amount and margin_percentage.
    """
    li = read_table(spark, sf_dir, "lineitem")
    hosp = supplier_hospital(spark, sf_dir)
    if sku == "brand":
        part = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sku_id"), "p_retailprice")
        li = li.join(part, li.l_partkey == part.p_partkey)
    elif sku == "part":
        li = li.withColumn("sku_id", F.col("l_partkey").cast("string"))
    else:
        raise ValueError(f"unknown sku mapping {sku!r}")
    li = li.join(hosp, li.l_suppkey == hosp.s_suppkey)
    revenue = revenue_expr(F.col("l_extendedprice"), F.col("l_discount"))
    money = [F.col("p_retailprice").alias("unit_cogs"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
             (revenue.cast("double") - F.col("l_quantity") * F.col("p_retailprice")).alias("margin_amount"),
             margin_percentage(revenue, F.col("l_quantity"), F.col("p_retailprice")).alias("margin_percentage")]
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("transaction_id"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("transaction_code"),
        "hospital_id",
        "sku_id",
        F.col("l_shipdate").alias("transaction_time"),
        F.col("l_quantity").alias("quantity_consumed"),
        revenue.alias("total_revenue"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("transaction_type"),
        revenue_units_expr(F.col("l_extendedprice"), F.col("l_discount")).alias("revenue_units"),
        *(money if margins else []),
    )


# SQL twin of `transactions`, for the DuckDB oracle and for `spark.sql` users.
TX_SQL = """
transactions AS (
  SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) AS transaction_id,
         l.l_returnflag || '_' || l.l_linestatus AS transaction_code,
         CAST(n.n_regionkey AS VARCHAR) AS hospital_id,
         p.p_brand AS sku_id,
         l.l_shipdate AS transaction_time,
         l.l_quantity AS quantity_consumed,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
              * (CAST(1 AS DECIMAL(18,2)) - CAST(l.l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS total_revenue,
         l.l_returnflag || '_' || l.l_linestatus AS transaction_type
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

TX_PART_SQL = """
transactions AS (
  SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) AS transaction_id,
         CAST(n.n_regionkey AS VARCHAR) AS hospital_id,
         CAST(l.l_partkey AS VARCHAR) AS sku_id,
         l.l_shipdate AS transaction_time,
         l.l_quantity AS quantity_consumed,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
              * (CAST(1 AS DECIMAL(18,2)) - CAST(l.l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS total_revenue
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""


def landing_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing shape: every column text except `transaction_time` (as the
    relational landing table is), with the 20 reference column names. Columns
    the star schema has no source for are NULL text."""
    tx = transactions(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    null = F.lit(None).cast("string")
    return tx.select(
        "transaction_id", s("transaction_code").alias("transaction_code"),
        "hospital_id", null.alias("dept_id"), null.alias("physician_id"), null.alias("patient_id"),
        null.alias("prescription_id"), null.alias("prescription_detail_id"), null.alias("bill_id"),
        null.alias("procedure_id"), "sku_id", "transaction_time",
        s("quantity_consumed").alias("quantity_consumed"), null.alias("unit_cogs"), null.alias("unit_price"),
        null.alias("margin_amount"), null.alias("margin_percentage"),
        s("total_revenue").alias("total_revenue"), "transaction_type", null.alias("last_updated"),
    )


def sku_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKU master (text landing shape) from `part`: one row per part."""
    part = read_table(spark, sf_dir, "part")
    null = F.lit(None).cast("string")
    return part.select(
        F.col("p_partkey").cast("string").alias("sku_id"),
        F.col("p_brand").alias("sku_code"),
        F.col("p_name").alias("sku_name"),
        F.col("p_type").alias("category"),
        null.alias("sub_category"),
        null.alias("therapeutic_area"),
        null.alias("brand_generic_flag"),
        null.alias("formulary_status"),
        F.lit("unit").alias("unit_of_measure"),
        F.col("p_retailprice").cast("string").alias("standard_cost"),
        null.alias("shelf_life_days"),
        null.alias("storage_requirements"),
        null.alias("controlled_substance_flag"),
        null.alias("halal_certified"),
        null.alias("base_drug_name"),
        F.col("p_size").cast("string").alias("minimum_order_quantity"),
        null.alias("abc_classification"),
        null.alias("item_status"),
        null.alias("last_updated"),
        null.alias("current_reorder_level"),
        null.alias("ideal_forecasted_reorder_level"),
        null.alias("reorder_quantity"),
        null.alias("lead_time"),
    )
