"""the work of the staged run per row - the split's write, value counts, independent writes side by side."""

import pytest
from pyspark.sql import functions as F

from stockpulse.operators import cleaning, profile, rules
from stockpulse.session import run_folder, session_conf, side_by_side, written_table
from stockpulse.sources import zones

SUITE = [rules.Rule(rules.NOT_NULL, "id"), rules.Rule(rules.UNIQUE, "id"), rules.Rule(rules.UNIQUE, "code"),
         rules.Rule(rules.BETWEEN, "q", min_value=0), rules.Rule(rules.NOT_NULL, "absent")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    some = [(str(i), f"c{i}", float(i)) for i in range(20)]
    odd = [("7", "x", -1.0), ("7", "c3", None), (None, "c3", float("nan")), (None, None, 1.0)]
    return spark.createDataFrame(some + odd, "id string, code string, q double")


def test_split_write_equals_its_rules_without_sort_or_lambda(spark, monkeypatch):
    df, seen = _rows(spark), {}
    kept = zones.counted

    def counted(marked, write, **metrics):
        seen["conf"] = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
        seen["plan"] = _plan(marked)
        return kept(marked, write, **metrics)
    monkeypatch.setattr(zones, "counted", counted)
    before = {k: spark.conf.get(k, None) for k in rules.SPLIT_CONF}
    path = run_folder(spark, "test_split_writes")
    suite = [r for r in SUITE if r.column != "absent"]
    got = rules.write_split(df, suite, path)
    passed, rejected = rules.read_split(spark, path)
    ids = {str(i) for i in range(20)} - {"7", "3"}                    # c3 is the code of three rows
    assert {r["id"] for r in passed.collect()} == ids
    failed = {(r["id"], r["code"], tuple(r["failed_rules"])) for r in rejected.collect()}
    assert failed == {("7", "c7", ("id_unique",)), ("3", "c3", ("code_unique",)), ("7", "x", ("id_unique", "q_between")),
                      ("7", "c3", ("id_unique", "code_unique")), (None, "c3", ("id_not_null", "code_unique", "q_between")),
                      (None, None, ("id_not_null",))}
    assert got == {"rows": 24, "passed": 18, "rejected": 6, "rule:id_not_null": 2, "rule:id_unique": 3,
                   "rule:code_unique": 3, "rule:q_between": 2}
    # more files may be open than there are outcomes: at as many as allowed Spark sorts the rest
    assert int(seen["conf"]) > 2 and "lambda" not in seen["plan"]
    # the repeated keys are a written table of known size: few are broadcast, no row is shuffled for them
    assert "HashAggregate" not in seen["plan"] and seen["plan"].count("BroadcastHashJoin") == 2
    assert {k: spark.conf.get(k, None) for k in rules.SPLIT_CONF} == before


def test_rules_of_missing_columns_fail_every_row(spark):
    out = rules.annotate(_rows(spark), SUITE).select("id", "failed_rules").collect()
    assert len(out) == 24 and all(r["failed_rules"][-1] == "absent_not_null" for r in out)


def test_written_keys_leave_plain_shuffles_for_a_hot_key(spark):
    """Both sides of the join are plain shuffles, which AQE can split where a key is hot."""
    df = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("id"),
                                  F.col("id").cast("string").alias("code"), F.lit(1.0).alias("q"))
    keys = lambda rows, c: written_table(rules.repeated_keys(rows, c), "test")
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", **rules.SPLIT_CONF}):
        out = rules.annotate(df, SUITE[:2], keys)
        assert out.where(F.size("failed_rules") > 0).count() == 2000
        plan = _plan(out)
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning(id") == 2


def test_value_counts_by_unpivot(spark):
    df = spark.createDataFrame([("a", 1.5, None), ("a", 1.5, None), ("b", None, None)], "`x.y` string, `0` double, n string")
    got = profile.value_counts(df)
    assert got.columns == ["column_name", "value", "cnt"]
    assert {tuple(r) for r in got.collect()} == {("x.y", "a", 2), ("x.y", "b", 1), ("0", "1.5", 2)}
    assert "Generate" not in _plan(got)


def test_clean_numbers_that_are_doubles_already(spark):
    df = spark.createDataFrame([(1.5, "A_b-c ", "2.5"), (float("inf"), None, "1d"), (float("nan"), "x", "3"), (None, "y", "4")],
                               "quantity_consumed double, transaction_type string, total_revenue string")
    out = cleaning.clean_transactions(df)
    assert [tuple(r) for r in out.orderBy("quantity_consumed").collect()] == [(1.5, "a b c", 2.5), (float("inf"), None, None)]
    assert "cast(quantity_consumed" not in _plan(out)


def test_side_by_side_ends_all_before_it_raises():
    import time
    done = []

    def late():
        time.sleep(0.2)
        done.append(1)

    def bad():
        raise ValueError("first")
    with pytest.raises(ValueError, match="first"):
        side_by_side(bad, late)
    assert done == [1]
