"""Split, folds, metrics, registry, intervals, roll-forward and models
(FIXTURES §4, §7) against brute-force Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockpulse.operators import evaluation as ev, forecast as fc, models as M
from stockpulse.operators.models import TreeParams


def _series(spark, n_by_sku, hospitals=("h1",)):
    rng = random.Random(11)
    rows = []
    for sku, n in n_by_sku.items():
        for h in hospitals:
            d = dt.date(2021, 1, 1)
            for i in range(n):
                d += dt.timedelta(days=1)
                rows.append((sku, h, d, float(rng.randint(0, 9))))
    return spark.createDataFrame(rows, "sku_id string, hospital_id string, ds date, qty_1d double")


def test_split_and_folds_match_positions(spark):
    df = _series(spark, {"a": 30, "b": 101}, hospitals=("h1", "h2"))
    sp = ev.chrono_split(df, "sku_id", "ds", "hospital_id").collect()
    for sku in ("a", "b"):
        rows = sorted([r for r in sp if r["sku_id"] == sku], key=lambda r: (r["ds"], r["hospital_id"]))
        n = len(rows)
        assert [r["pos"] for r in rows] == list(range(n))
        assert sum(r["is_train"] for r in rows) == int(0.8 * n)
        assert all(r["is_train"] for r in rows[:int(0.8 * n)])
    folds = ev.time_folds(df, "sku_id", "ds", "hospital_id").where("sku_id = 'b'").collect()
    n, ts = 202, 202 // 3
    for f in (0, 1):
        tr = sorted(r["pos"] for r in folds if r["fold"] == f and r["role"] == "train")
        te = sorted(r["pos"] for r in folds if r["fold"] == f and r["role"] == "test")
        end = n - (2 - f) * ts
        assert tr == list(range(end)) and te == list(range(end, end + ts))


def test_mape_zero_rule_and_metrics(spark):
    rows = [("s", 0.0, 0.0), ("s", 0.0, 5.0), ("s", 1e-9, 0.0), ("s", 4.0, 2.0)]
    df = spark.createDataFrame(rows, "sku_id string, y double, p double")
    m = ev.regression_metrics(df, ["sku_id"], "y", "p").first()
    assert abs(m["mape"] - (0 + 100 + 0 + 50) / 4) < 1e-12
    assert abs(m["mae"] - (0 + 5 + 1e-9 + 2) / 4) < 1e-12
    assert abs(m["rmse"] - ((25 + 1e-18 + 4) / 4) ** 0.5) < 1e-12


def test_versions_numeric_order_and_interval(spark):
    runs = spark.createDataFrame([("1", dt.datetime(2024, 1, d), f"r{d}") for d in range(1, 12)],
                                 "sku_id string, run_ts timestamp, run_id string")
    v = ev.register_versions(runs, "sku_id", "run_ts", "run_id")
    latest = ev.resolve_model(v).first()
    assert latest["version"] == "11" and latest["stage"] == "Production"   # '11' > '9'
    assert ev.resolve_model(v, "Archived").first()["version"] == "10"
    preds = spark.createDataFrame([("1", 10.0, None), ("2", -4.0, 50.0)], "sku_id string, p double, mape double")
    out = {r["sku_id"]: r for r in ev.with_interval(preds, "p", "mape").collect()}
    assert out["1"]["mape_used"] == 20.0 and abs(out["1"]["upper"] - (10 + 1.96 * 0.2 * 10)) < 1e-12
    assert abs(out["2"]["lower"] - (-4 - 1.96 * 0.5 * 4)) < 1e-12


def test_roll_forward_on_a_constant_series(spark):
    """A constant series stays constant: every sum and mean follows from the level."""
    d0 = dt.date(2023, 12, 1)
    rows = [("s", "h", d0 + dt.timedelta(days=i), 4.0, 10.0) for i in range(40)]
    df = spark.createDataFrame(rows, "sku_id string, hospital_id string, ds date, qty_1d double, rev_1d double")
    got = fc.roll_forward(df, ["hospital_id", "sku_id"], 3).orderBy("step").collect()
    assert [g["ds"] for g in got] == [dt.date(2024, 1, 10), dt.date(2024, 1, 11), dt.date(2024, 1, 12)]
    assert [(g["dow"], g["is_weekend"], g["week_of_year"], g["month"]) for g in got] == [(2, 0, 2, 1), (3, 0, 2, 1), (4, 0, 2, 1)]
    for g in got:
        assert (g["lag_qty_1d"], g["lag_qty_7d"], g["qty_7d"], g["qty_28d"], g["avg_qty_7d"], g["avg_qty_28d"]) == \
            (4.0, 4.0, 28.0, 112.0, 4.0, 4.0)
        assert (g["rev_7d"], g["rev_28d"], g["avg_rev_7d"], g["avg_rev_28d"]) == (70.0, 280.0, 10.0, 10.0)


def test_roll_forward_expected_rows(spark):
    """History 1, 2, ..., 30 (30 days): rows worked out by hand. Day 1 sees
    24..30 (sum 189, mean 27), so 27 is appended; day 2 sees 25..30 and 27 (192)."""
    d0 = dt.date(2024, 1, 1)
    rows = [("s", "h", d0 + dt.timedelta(days=i), float(i + 1), float(i + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "sku_id string, hospital_id string, ds date, qty_1d double, rev_1d double")
    one, two = fc.roll_forward(df, ["hospital_id", "sku_id"], 2).orderBy("step").collect()
    assert (one["lag_qty_1d"], one["lag_qty_7d"], one["qty_7d"], one["qty_28d"]) == (30.0, 24.0, 189.0, 462.0)
    assert (two["lag_qty_1d"], two["lag_qty_7d"], two["qty_7d"], two["qty_28d"]) == (27.0, 25.0, 192.0, 486.0)
    assert (one["ds"], two["ds"]) == (dt.date(2024, 1, 31), dt.date(2024, 2, 1))


@pytest.mark.parametrize("n_hist, n_rows", [(29, 0), (30, 4), (36, 4)])
def test_roll_forward_history_gate(spark, n_hist, n_rows):
    d0 = dt.date(2024, 1, 1)
    rows = [("s", "h", d0 + dt.timedelta(days=i), 1.0, 1.0) for i in range(n_hist)]
    df = spark.createDataFrame(rows, "sku_id string, hospital_id string, ds date, qty_1d double, rev_1d double")
    assert fc.roll_forward(df, ["hospital_id", "sku_id"], 4).count() == n_rows


def test_horizon_bounds_and_bround(spark):
    with pytest.raises(ValueError):
        fc.check_horizon(0)
    with pytest.raises(ValueError):
        fc.check_horizon(91)
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "p double")
    assert [r[0] for r in df.select(fc.round_prediction(F.col("p"))).collect()] == [0, 2, 2, 0]


def _feature_rows(spark, sizes, bad=()):
    rng = random.Random(5)
    rows = []
    for sku, n in sizes:
        d = dt.date(2022, 1, 1)
        for i in range(n):
            d += dt.timedelta(days=1)
            x = [float(rng.randint(0, 100)) for _ in range(10)]
            q = x[0] / 2 + (5.0 if d.weekday() >= 5 else 0.0)
            rows.append((sku, "h", d, d.isoweekday(), int(d.weekday() >= 5), 1, d.month, None if (sku, i) in bad else q, *x))
    cols = ("sku_id string, hospital_id string, ds date, dow int, is_weekend int, week_of_year int, month int, "
            "qty_1d double, qty_7d double, qty_28d double, avg_qty_7d double, avg_qty_28d double, lag_qty_1d double, "
            "lag_qty_7d double, rev_7d double, rev_28d double, avg_rev_7d double, avg_rev_28d double")
    return spark.createDataFrame(rows, cols)


def test_pooled_model_of_all_skus(spark, tmp_path):
    feats = _feature_rows(spark, [("big", 300), ("A#1", 100), ("small", 40), ("broken", 100)], bad={("broken", 3)})
    params = TreeParams(max_iter=10, max_depth=4)
    path = str(tmp_path / "models")
    assert not M.is_saved(spark, path)
    M.train(feats, params).save(path)
    assert M.is_saved(spark, path)
    fitted = M.load(spark, path)
    got = {r["sku_id"]: r for r in fitted.skus.collect()}
    assert set(got) == {"big", "A#1", "broken"}                       # 40 rows < 90: skipped
    assert got["broken"]["error"] and got["broken"]["mape"] is None    # one SKU's fault stays its own
    assert (got["big"]["n_train"], got["big"]["n_test"]) == (240, 60)
    assert got["big"]["mae"] < 5 and got["big"]["mae"] < got["big"]["naive_mae"]      # the target follows the features
    summary = M.training_summary(fitted.skus).collect()
    assert summary[-1]["sku_id"] == "broken" and summary[0]["mape"] <= summary[1]["mape"]
    assert {r["value"] for r in M.params_table(fitted.skus).filter("key = 'max_iter'").collect()} == {"10"}
    assert M.metrics_table(fitted.skus).count() == 8
    # encodings come from the training rows only
    train = [r["qty_1d"] for r in feats.filter("sku_id = 'big'").orderBy("ds").collect()][:240]
    assert abs(got["big"]["sku_mean"] - sum(train) / 240) < 1e-9
    # every row comes out once: NULL keys, SKUs without a model, missing inputs
    extra = feats.filter("sku_id = 'big'").limit(3).withColumn("sku_id", F.lit(None).cast("string")) \
        .unionByName(feats.filter("sku_id = 'big'").limit(2).withColumn("qty_7d", F.lit(None).cast("double")))
    out = M.score(feats.unionByName(extra), fitted).collect()
    assert len(out) == 540 + 5
    assert sum(r["error"] == "no model" for r in out) == 3 + 40 + 100
    assert sum(r["error"] == "invalid input" for r in out) == 2
    assert all((r["prediction"] is None) == (r["error"] is not None) for r in out)


def test_no_sku_can_be_trained(spark, tmp_path):
    feats = _feature_rows(spark, [("small", 40), ("broken", 100)], bad={("broken", 3)})
    M.train(feats, TreeParams(max_iter=2)).save(str(tmp_path / "none"))
    fitted = M.load(spark, str(tmp_path / "none"))
    assert fitted.model is None and [r["sku_id"] for r in fitted.skus.collect()] == ["broken"]
    assert {r["error"] for r in M.score(feats, fitted).collect()} == {"no model"}


def test_random_search_takes_the_better_draw(spark):
    feats = _feature_rows(spark, [("a", 200), ("b", 150)])
    rows = M.prepare(feats).withColumn("sku_mean", F.lit(0.0)).withColumn("sku_std", F.lit(0.0))
    train = M.vectors(ev.positions(rows, "sku_id", "ds", "hospital_id")).cache()
    poor, good = TreeParams(max_iter=1, step_size=0.01, max_depth=1), TreeParams(max_iter=6, max_depth=4)
    broken = TreeParams(max_depth=99)                                  # cannot be fitted: does not take part
    assert M.search(train, TreeParams(), [poor, broken, good]) == good
    assert M.search(train, TreeParams(max_iter=2), [broken]) == TreeParams(max_iter=2)
    assert M.draw_params(TreeParams()) == M.draw_params(TreeParams()) and len(set(M.draw_params(TreeParams()))) == 5
    train.unpersist()


def test_tuning_is_per_gate(spark):
    feats = _feature_rows(spark, [("a", 160), ("b", 100)])             # 128 and 80 training rows; the gate is 100
    skus = {r["sku_id"]: r for r in M.train(feats, TreeParams(max_iter=2, max_depth=2), tune=True).skus.collect()}
    assert (skus["a"]["tuned"], skus["a"]["draws"], skus["a"]["folds"], skus["a"]["fold_rows"]) == (True, 5, 2, 2 * (128 // 3))
    assert skus["b"]["tuned"] is False and skus["b"]["draws"] is None and skus["b"]["mape"] is not None


def test_first_store_wins(spark):
    schema = "sku_id string, mape double, error string"
    a = spark.createDataFrame([("s", 1.0, None), ("t", None, "failed")], schema)
    b = spark.createDataFrame([("s", 2.0, None), ("t", 3.0, None), ("u", None, "failed")], schema)
    assert {r["sku_id"]: (r["store"], r["mape"]) for r in M.first_models([a, b]).collect()} == {"s": (0, 1.0), "t": (1, 3.0)}
