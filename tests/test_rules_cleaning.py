"""Rules, cleaning and landing on literal edge rows (FIXTURES §1-§2)."""

import datetime as dt

from pyspark.sql import functions as F

from stockpulse.functions import parsing as P
from stockpulse.operators import cleaning, landing, rules

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _tx(spark, rows):
    cols = list(rules.TRANSACTION_COLUMNS)
    full = []
    for r in rows:
        d = {c: None for c in cols}
        d.update(r)
        full.append(tuple(d[c] for c in cols))
    schema = ", ".join(f"{c} {'timestamp' if c == 'transaction_time' else 'string'}" for c in cols)
    return spark.createDataFrame(full, schema)


def test_rule_split_edge_rows(spark):
    rows = [
        {"transaction_id": None, "sku_id": "a", "transaction_time": T0, "quantity_consumed": "1"},
        {"transaction_id": "dup", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "1"},
        {"transaction_id": "dup", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "2"},
        {"transaction_id": "dup", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "3"},
        {"transaction_id": "n1", "sku_id": None, "transaction_time": T0, "quantity_consumed": "1"},
        {"transaction_id": "n2", "sku_id": "a", "transaction_time": None, "quantity_consumed": "1"},
        {"transaction_id": "q1", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "-1"},
        {"transaction_id": "q2", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "0"},
        {"transaction_id": "q3", "sku_id": "a", "transaction_time": T0, "quantity_consumed": None},
        {"transaction_id": "q4", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "abc"},
        {"transaction_id": "q5", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "NaN"},
        {"transaction_id": "ok", "sku_id": "a", "transaction_time": T0, "quantity_consumed": " 12 "},
    ]
    df = _tx(spark, rows).withColumn("quantity_consumed", P.to_number(F.col("quantity_consumed")))
    passed, rejected = rules.split(df, rules.TRANSACTIONS_SUITE)
    got = {r["transaction_id"]: sorted(r["failed_rules"]) for r in rejected.collect()}
    assert got[None] == ["transaction_id_not_null"]
    assert got["dup"] == ["transaction_id_unique"]           # every copy rejected
    assert got["n1"] == ["sku_id_not_null"]
    assert got["n2"] == ["transaction_time_not_null"]
    assert got["q1"] == ["quantity_consumed_between"]
    assert sorted(r["transaction_id"] for r in passed.collect()) == ["ok", "q2", "q3", "q4", "q5"]
    assert len(rejected.collect()) == 7

    res = {r["rule"]: r for r in rules.results(df, rules.TRANSACTIONS_SUITE).collect()}
    assert res["transaction_id_unique"]["unexpected_count"] == 3
    assert res["quantity_consumed_between"]["unexpected_count"] == 1
    assert res["quantity_consumed_between"]["element_count"] == 9   # non-null quantities
    assert not res["transaction_id_unique"]["success"]


def test_column_set_rule(spark):
    df = _tx(spark, [{"transaction_id": "x"}]).drop("bill_id").withColumn("extra", F.lit(1))
    r = rules.column_set_result(df, rules.TRANSACTIONS_SUITE[0])
    assert not r["success"] and r["missing"] == ["bill_id"] and r["unexpected"] == ["extra"]


def test_to_number_grammar(spark):
    vals = ["-1", "0", None, "abc", "1d", "NaN", " 12 ", "1e3", "1f", ".5", "3.", "+2", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(P.to_number(F.col("v"))).collect()]
    assert got == [-1.0, 0.0, None, None, None, None, 12.0, 1000.0, None, 0.5, 3.0, 2.0, float("inf")]


def test_clean_transactions(spark):
    rows = [
        {"transaction_id": "1", "transaction_code": " Sale_Return-X ", "sku_id": "a",
         "transaction_time": T0, "quantity_consumed": "5", "bill_id": "b", "physician_id": "p"},
        {"transaction_id": "2", "transaction_code": None, "sku_id": "a", "transaction_time": T0,
         "quantity_consumed": "-1"},
        {"transaction_id": "3", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "NaN"},
        {"transaction_id": "4", "sku_id": "a", "transaction_time": T0, "quantity_consumed": None,
         "last_updated": "2024-01-02 03:04:05"},
        {"transaction_id": "5", "sku_id": "a", "transaction_time": T0, "quantity_consumed": "0",
         "last_updated": "not a time"},
    ]
    out = cleaning.clean_transactions(_tx(spark, rows))
    assert "bill_id" not in out.columns and "physician_id" not in out.columns
    got = {r["transaction_id"]: r for r in out.collect()}
    assert sorted(got) == ["1", "5"]                      # negative, NaN, missing dropped
    assert got["1"]["transaction_code"] == "sale return x"
    assert got["5"]["last_updated"] is None
    assert dict(out.dtypes)["quantity_consumed"] == "double"


def test_clean_sku_master(spark):
    cols = ["SKU ID", "sku_name", "therapeutic_area", "brand_generic_flag", "empty_col", "category"]
    rows = [("1", "x", None, "unknown", None, " unknown "),
            ("2", "y", "Oncology", "UNKNOWN", None, "NULL"),
            ("3", "z", "nan", "Generic", None, "")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))
    out = cleaning.clean_sku_master(df)
    assert "empty_col" not in out.columns and "sku_id" in out.columns
    got = {r["sku_id"]: r for r in out.collect()}
    assert got["1"]["therapeutic_area"] == "Medical_supplies"
    assert got["1"]["brand_generic_flag"] == "Not Applicable"     # sentinel -> NULL -> fill
    assert got["2"]["brand_generic_flag"] == "UNKNOWN"            # case-sensitive: stays
    assert got["1"]["category"] == " unknown "                     # whole-value only: stays
    assert got["2"]["category"] is None and got["3"]["category"] is None
    assert got["3"]["therapeutic_area"] == "Medical_supplies"


def test_keyed_first_wins_and_row_hash(spark):
    df = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("b", "only", 5), ("a", "third", 3)],
                               "sku_id string, name string, pos int")
    out = {r["sku_id"]: r["name"] for r in landing.keyed_first_wins(df, ["sku_id"], "pos").collect()}
    assert out == {"a": "first", "b": "only"}

    t = spark.createDataFrame([("x", None, T0), ("x", None, T0), ("x", "nan", T0)],
                              "a string, b string, transaction_time timestamp")
    loaded = landing.load_transactions(t)
    # a NULL and the text 'nan' hash alike, as the source's str() conversion does
    assert loaded.count() == 1
    assert loaded.select("row_hash").first()[0] == __import__("hashlib").md5(f"x||nan||{T0}".encode()).hexdigest()


def test_key_list_parsing(spark):
    r = spark.range(1).select(P.parse_key_list(F.lit("12, 7,,3 ,")).alias("k")).first()["k"]
    assert r == [12, 7, 3]


def test_times_are_tried_in_the_formats_of_their_separators(spark):
    """Each format is still found as by trying all of them; a text meets only the formats it may have."""
    d, m = ["2024-02-29", "2023-02-29", "+12024-01-02", "-2024-01-02", "0000-01-01", "2024-1-2", "24-01-02", "20240102"], ["02/29/2024", "2024/02/29", "2/9/2024", "29/02/2024"]
    t = ["", " 10:11:12", "T10:11:12", "t10:11:12", " 10:11", "T10:11", " 24:00:00", "  10:11:12", " 10:11:12.", " 10:11:12.1", " 10:11:12.123",
         " 10:11:12.1234567", "T10:11:12.123456", "t10:11:12.1", " 10:11:12 ", "Z", "x", "\t"]
    texts = [a + b for a in d + m for b in t] + ["yesterday", "", " ", None, "-", "T", "::", "//", " 2024-01-02 ", "\u0662\u0660\u0662\u0664-01-02"]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    every = F.coalesce(*[F.try_to_timestamp(F.trim("v"), F.lit(f)) for f in P.TIME_FORMATS]).cast("timestamp_ntz")
    rows = df.select("v", P.to_timestamp_lenient(F.col("v")).cast("string"), every.cast("string")).collect()
    assert [r for r in rows if r[1] != r[2]] == [] and sum(r[1] is not None for r in rows) > 20
    # no text is tried in more formats than share its separators
    seps = [P._separators(f) for f in P.TIME_FORMATS]
    assert max(seps.count(x) for x in seps) == 2
