"""Partition reloads, catalog tables and counts taken from writes."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.operators import demand, rules
from stockpulse.session import run_folder
from stockpulse.sources import io, zones

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("month", T.StringType()), T.StructField("v", T.StringType())])


def rows(spark, months, v, n=200):
    return spark.createDataFrame([(i, m, v) for m in months for i in range(n)], SCHEMA).repartition(7)


def files(spark, path, month):
    return sorted(spark.read.parquet(f"{path}/month={month}").inputFiles())


def test_reload_replaces_only_its_partitions(spark):
    path = run_folder(spark, "test_months")
    months = [f"2024-{m:02d}" for m in range(1, 7)]
    zones.reload_partitions(rows(spark, months, "old"), path, "month", sort_within=["id"])
    before = {m: files(spark, path, m) for m in months}
    assert all(1 <= len(f) <= 2 for f in before.values())          # not one per task
    zones.reload_partitions(rows(spark, ["2024-03"], "new", 5), path, "month")
    after = {m: files(spark, path, m) for m in months}
    assert {m for m in months if before[m] != after[m]} == {"2024-03"}
    got = zones.read_partitions(spark, path, SCHEMA)
    assert got.columns == ["id", "month", "v"] and got.schema["month"].dataType == T.StringType()
    assert {(r["month"], r["v"]): r["n"] for r in got.groupBy("month", "v").agg(F.count("*").alias("n")).collect()} == \
        {(m, "old"): 200 for m in months if m != "2024-03"} | {("2024-03", "new"): 5}


def test_filter_on_the_partition_column_prunes(spark, capsys):
    path = run_folder(spark, "test_prune")
    zones.reload_partitions(rows(spark, ["a", "b", "c"], "x", 3), path, "month")
    one = zones.read_partitions(spark, path, SCHEMA).where("month = 'b'")
    one.explain("formatted")
    assert "PartitionFilters: [isnotnull(month" in capsys.readouterr().out
    assert one.count() == 3


def test_empty_reload_keeps_everything(spark):
    path = run_folder(spark, "test_empty")
    zones.reload_partitions(rows(spark, ["a"], "x", 3), path, "month")
    zones.reload_partitions(rows(spark, [], "x"), path, "month")
    assert zones.read_partitions(spark, path, SCHEMA).count() == 3


DAILY = T.StructType([T.StructField("sku_id", T.StringType()), T.StructField("hospital_id", T.StringType()),
                      T.StructField("tx_date", T.DateType()), T.StructField("total_quantity", T.DoubleType()),
                      T.StructField("total_revenue", T.DoubleType())])


def test_series_windows_read_the_catalog_table_without_an_exchange(spark, capsys):
    d = spark.range(400).select((F.col("id") % 5).cast("string").alias("sku_id"), (F.col("id") % 3).cast("string").alias("hospital_id"),
                                F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 15).cast("int")).alias("tx_date"),
                                F.col("id").cast("double").alias("total_quantity"), F.lit(1.0).alias("total_revenue"))
    name = zones.save_table(d, "stockpulse_test", f"daily_{uuid.uuid4().hex}", DAILY, demand.SERIES_KEYS,
                            [*demand.SERIES_KEYS, "tx_date"], run_folder(spark, "test_table"), buckets=4)
    table = spark.table(name)
    assert table.schema == DAILY
    features = demand.demand_features(table)
    features.explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" in plan and "Exchange" not in plan
    assert sorted(map(tuple, features.collect())) == sorted(map(tuple, demand.demand_features(d).collect()))
    with pytest.raises(ValueError, match="total_quantity: declared double, got string"):
        zones.save_table(d.withColumn("total_quantity", F.lit("x")), "stockpulse_test", "bad", DAILY, ["sku_id"], ["sku_id"],
                         run_folder(spark, "test_table"))
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("n", [0, 1, 500])
def test_counts_come_from_the_write(spark, n):
    path = run_folder(spark, "test_counted")
    got = zones.counted(spark.range(n), lambda x: io.write_table(x, path), even=F.count_if(F.col("id") % 2 == 0))
    assert got == {"rows": n, "even": (n + 1) // 2}
    assert spark.read.schema("id long").parquet(path).count() == n


def test_split_counts_and_results_agree_with_hand_counts(spark):
    data = [("1", "s", "t", 1.0), ("1", "s", "t", -1.0), (None, None, "t", None), ("2", "s", None, float("nan")), (None, "s", "t", 2.0),
            ("9", "s", "t", 0.0)]
    df = spark.createDataFrame(data, "transaction_id string, sku_id string, transaction_time string, quantity_consumed double")
    want = {"transaction_id_not_null": 2, "transaction_time_not_null": 1, "sku_id_not_null": 1, "transaction_id_unique": 2,
            "quantity_consumed_between": 2}
    got = rules.write_split(df, rules.TRANSACTIONS_SUITE, run_folder(spark, "test_split"))
    assert got == {"rows": 6, "passed": 1, "rejected": 5} | {f"rule:{k}": v for k, v in want.items()}
    res = {r["rule"]: r for r in rules.results(df, rules.TRANSACTIONS_SUITE).collect()}
    assert {k: res[k]["unexpected_count"] for k in want} == want
    assert res["transaction_id_unique"]["element_count"] == 4 and res["sku_id_not_null"]["element_count"] == 6
    two = [rules.Rule(rules.UNIQUE, "transaction_id"), rules.Rule(rules.UNIQUE, "sku_id"), rules.Rule(rules.NOT_NULL, "sku_id")]
    assert {r["rule"]: r["unexpected_count"] for r in rules.results(df, two).collect()} == \
        {"transaction_id_unique": 2, "sku_id_unique": 5, "sku_id_not_null": 1}
    none = {r["rule"]: r["unexpected_count"] for r in rules.results(df.limit(0), two).collect()}
    assert set(none.values()) == {0}
