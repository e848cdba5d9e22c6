"""Staged batch run (L13, L14): validation -> clean zone -> daily table -> feature
tables -> event table and exports, for the transactions and the SKU master, each
stage wrapped in the run log (START / COMPLETE / FAIL with duration and schemas).
Stages communicate through written tables under `out_base` (a shared folder), so a
lost executor costs at most the current stage, and any stage can be run alone (`only=`).

Row counts (per table, per outcome and per rule) are observed while the tables are written and
go into the run log; nothing is read again to be counted.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockpulse.functions.parsing import to_number
from stockpulse.operators import cleaning, demand, profile, rules
from stockpulse.operators.monitoring import RunLog, logged_counts
from stockpulse.session import side_by_side
from stockpulse.sources import io
from stockpulse.sources.zones import counted
from stockpulse.sources.tables import landing_transactions, sku_master

STAGES = ("zones", "data_validation", "clean_zone", "daily_table", "feature_store_full", "feature_store_top10",
          "event_features")
DATABASE = "stockpulse_zones"

# Output tables by stage; names ending in _csv are CSV folders.
TABLES = {
    "data_validation": ["raw_zone/inventory_transactions", "raw_zone/inventory_transactions_rejected",
                        "raw_zone/sku_master", "raw_zone/sku_master_rejected",
                        "raw_zone/inventory_transactions_valid_csv", "raw_zone/sku_master_valid_csv",
                        "profiles/inventory_transactions_describe_csv", "profiles/inventory_transactions_nulls_csv",
                        "profiles/sku_master_describe_csv", "profiles/sku_master_nulls_csv"],
    "clean_zone": ["clean_zone/inventory_transactions", "clean_zone/sku_master",
                   "clean_zone/inventory_transactions_csv", "clean_zone/sku_master_csv"],
    "daily_table": ["clean_zone/daily_sku_demand"],
    "feature_store_full": ["feature_store/sku_demand_daily_features"],
    "feature_store_top10": ["feature_store/sku_demand_daily_features_top_10"],
    "event_features": ["feature_store/sku_event_features"],
}


def _landing(spark, sf_dir) -> dict[str, tuple[DataFrame, list]]:
    tx = landing_transactions(spark, sf_dir).withColumn("quantity_consumed", to_number(F.col("quantity_consumed")))
    return {"inventory_transactions": (tx, rules.TRANSACTIONS_SUITE), "sku_master": (sku_master(spark, sf_dir), rules.SKU_SUITE)}


def run_stages(spark: SparkSession, sf_dir: str, out_base: str, only: str | None = None,
               run_id: str | None = None, export_date: str | None = None) -> RunLog:
    out = out_base.rstrip("/")
    log = RunLog(spark, f"{out}/run_log")
    run_id = run_id or str(uuid.uuid4())
    at = lambda name: f"{out}/{name}"

    def table(counts: dict[str, int], df: DataFrame, name: str, **kw) -> None:
        counts[name] = counted(df, lambda x: io.write_table(x, at(name), **kw))["rows"]

    def csv(counts: dict[str, int], df: DataFrame, name: str) -> None:
        counts[name] = counted(df, lambda x: io.write_csv(x, at(name)))["rows"]

    def zones():
        io.ensure_database(spark, DATABASE)

    def validation():
        counts: dict[str, int] = {}

        def check(name, landing, suite):
            split = at(f"raw_zone/{name}_checked")
            seen = rules.write_split(landing, suite, split)       # the rules run once
            counts.update({f"{name}/{k}": n for k, n in seen.items()})
            passed, rejected = rules.read_split(spark, split)

            def keep_passed():
                table(counts, passed, f"raw_zone/{name}")
                valid = spark.read.parquet(at(f"raw_zone/{name}"))
                side_by_side(lambda: csv(counts, valid, f"raw_zone/{name}_valid_csv"),
                             lambda: csv(counts, profile.describe(valid), f"profiles/{name}_describe_csv"),
                             lambda: csv(counts, cleaning.null_counts(valid), f"profiles/{name}_nulls_csv"))

            def keep_rejected():
                if seen["rejected"]:
                    table(counts, rejected.withColumn("failed_rules", F.array_join("failed_rules", ",")),
                          f"raw_zone/{name}_rejected")
            side_by_side(keep_passed, keep_rejected)
        side_by_side(*[partial(check, name, *landed) for name, landed in _landing(spark, sf_dir).items()])
        return counts

    def clean_zone():
        counts: dict[str, int] = {}
        landed = _landing(spark, sf_dir)                               # for their schemas only

        def keep(name, clean):
            raw = io.read_zone(spark, at(f"raw_zone/{name}"), landed[name][0].schema)
            if raw.isEmpty():                                          # A4: no table or no rows, nothing to do
                return
            table(counts, clean(raw), f"clean_zone/{name}")
            csv(counts, spark.read.parquet(at(f"clean_zone/{name}")), f"clean_zone/{name}_csv")
        side_by_side(lambda: keep("inventory_transactions", cleaning.clean_transactions),
                     lambda: keep("sku_master", cleaning.clean_sku_master))
        return counts

    def daily_table():
        counts: dict[str, int] = {}
        tx = spark.read.parquet(at("clean_zone/inventory_transactions"))
        table(counts, demand.daily_demand(tx, keep_decimal=False), "clean_zone/daily_sku_demand",
              cluster_by=["hospital_id", "sku_id"], sort_within=["sku_id", "hospital_id", "tx_date"])
        return counts

    def features_full():
        counts: dict[str, int] = {}
        table(counts, demand.demand_features(spark.read.parquet(at("clean_zone/daily_sku_demand"))),
              "feature_store/sku_demand_daily_features", sort_within=["hospital_id", "sku_id", "ds"])
        return counts

    def features_top():
        counts: dict[str, int] = {}
        d = spark.read.parquet(at("clean_zone/daily_sku_demand"))
        t = demand.top_skus(d, demand.TOP_K, qty_col="total_quantity")
        table(counts, demand.demand_features(demand.restrict_to(d, t)),
              "feature_store/sku_demand_daily_features_top_10", sort_within=["hospital_id", "sku_id", "ds"])
        return counts

    def event_features():
        counts: dict[str, int] = {}
        tx = spark.read.parquet(at("clean_zone/inventory_transactions"))
        name = "feature_store/sku_event_features"
        table(counts, demand.event_features(tx), name, sort_within=["sku_id", "feature_timestamp"])
        day = export_date or spark.range(1).select(F.date_format(F.current_date(), "yyyyMMdd")).first()[0]
        io.write_csv(spark.read.parquet(at(name)), at(f"exports/sku_event_features_{day}_csv"))
        return counts

    steps = {"zones": zones, "data_validation": validation, "clean_zone": clean_zone, "daily_table": daily_table,
             "feature_store_full": features_full, "feature_store_top10": features_top, "event_features": event_features}
    before = {"zones": [], "data_validation": [sf_dir], "clean_zone": TABLES["data_validation"][:3:2],
              "daily_table": TABLES["clean_zone"][:1], "feature_store_full": TABLES["daily_table"],
              "feature_store_top10": TABLES["daily_table"], "event_features": TABLES["clean_zone"][:1]}
    for name in STAGES:
        if only is not None and name != only:
            continue
        log.run_step(name, steps[name], run_id=run_id, inputs=[p if p == sf_dir else at(p) for p in before[name]],
                     outputs=[at(p) for p in TABLES.get(name, [])])
    return log


def table_counts(log: RunLog) -> DataFrame:
    """(job, table_name, rows) of every table a run wrote, as the run log holds them; an unwritten
    table (no rejects) has no row. A CSV is counted as its rows, without headers."""
    names = [n for tables in TABLES.values() for n in tables]
    return logged_counts(log.read()).where(F.col("metric").isin(names)).select(
        "job", F.col("metric").alias("table_name"), F.col("value").alias("rows"))
