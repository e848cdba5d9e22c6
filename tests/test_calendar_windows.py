"""Calendar functions vs Python for every day 2010-2030, and the feature
windows vs a brute-force Python computation on edge series (FIXTURES §3)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stockpulse.functions import calendar as C
from stockpulse.operators import demand


def test_calendar_every_day(spark):
    start, end = dt.date(2010, 1, 1), dt.date(2030, 12, 31)
    n = (end - start).days + 1
    df = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    got = df.select("d", C.dow_iso(F.col("d")).alias("a"), C.dow_zero(F.col("d")).alias("b"),
                    C.week_sunday_start(F.col("d")).alias("c"), C.week_iso(F.col("d")).alias("e"),
                    C.is_weekend(F.col("d")).alias("w")).collect()
    assert len(got) == n
    for r in got:
        d = r["d"]
        assert r["a"] == d.isoweekday()
        assert r["b"] == d.weekday()
        assert r["c"] == int(d.strftime("%U"))
        assert r["e"] == d.isocalendar()[1]
        assert r["w"] == int(d.weekday() >= 5)


def _brute(series):
    """Reference semantics on one series of (date, qty, rev) sorted by date."""
    out = []
    q = [s[1] for s in series]
    r = [s[2] for s in series]
    for i, (d, qq, rr) in enumerate(series):
        w7, w28 = q[max(0, i - 6):i + 1], q[max(0, i - 27):i + 1]
        r7, r28 = r[max(0, i - 6):i + 1], r[max(0, i - 27):i + 1]
        out.append((d, sum(w7), sum(w28), sum(w7) / len(w7), sum(w28) / len(w28),
                    q[i - 1] if i >= 1 else 0.0, q[i - 7] if i >= 7 else 0.0,
                    sum(r7), sum(r28), sum(r7) / len(r7), sum(r28) / len(r28)))
    return out


def test_feature_windows_edge_series(spark):
    rng = random.Random(7)
    rows = []
    lengths = {"s1": 1, "s6": 6, "s7": 7, "s8": 8, "s27": 27, "s28": 28, "s29": 29, "gap": 12}
    expected = {}
    for sku, n in lengths.items():
        d = dt.date(2020, 1, 1)
        ser = []
        for i in range(n):
            d = d + dt.timedelta(days=40 if (sku == "gap" and i == 5) else 1)
            ser.append((d, float(rng.randint(1, 50)), float(rng.randint(100, 9999))))
        expected[sku] = _brute(ser)
        rows += [(sku, "h1", d_, q, r) for d_, q, r in ser]
    daily = spark.createDataFrame(rows, "sku_id string, hospital_id string, tx_date date, "
                                        "total_quantity double, total_revenue double")
    got = demand.demand_features(daily).orderBy("sku_id", "ds").collect()
    by = {}
    for r in got:
        by.setdefault(r["sku_id"], []).append(
            (r["ds"], r["qty_7d"], r["qty_28d"], r["avg_qty_7d"], r["avg_qty_28d"], r["lag_qty_1d"],
             r["lag_qty_7d"], r["rev_7d"], r["rev_28d"], r["avg_rev_7d"], r["avg_rev_28d"]))
    for sku, exp in expected.items():
        assert len(by[sku]) == len(exp)
        for a, b in zip(by[sku], exp):
            assert a[0] == b[0]
            for x, y in zip(a[1:], b[1:]):
                assert abs(x - y) < 1e-6 * max(1.0, abs(y))


def test_top_k_ties_broken_by_key(spark):
    rows = [(f"s{i:02d}", 10.0 if i < 12 else 1.0) for i in range(15)]
    df = spark.createDataFrame(rows, "sku_id string, quantity_consumed double")
    top = [r["sku_id"] for r in demand.top_skus(df, 10).collect()]
    assert top == [f"s{i:02d}" for i in range(10)]
