"""p-values against tabulated quantiles and independent sums; the drift preset's two branches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stockpulse.functions.distributions import chi_square_p, kolmogorov_p, log_gamma_half
from stockpulse.operators import profile

# Tabulated upper quantiles.
CHI = [(1, 3.841459, 0.05), (1, 6.634897, 0.01), (2, 5.991465, 0.05), (5, 11.070498, 0.05), (10, 18.307038, 0.05),
       (10, 23.209251, 0.01), (24, 36.415029, 0.05), (30, 50.892181, 0.01), (100, 124.342113, 0.05), (100, 77.929465, 0.95)]
KOLMOGOROV = [(1.22385, 0.10), (1.35810, 0.05), (1.62762, 0.01), (0.82757, 0.50), (0.57117, 0.90)]


def test_chi_square_table(spark):
    df = spark.createDataFrame([(float(x), k) for k, x, _ in CHI], "x double, k int")
    for r, (_, _, p) in zip(df.select(chi_square_p(F.col("x"), F.col("k")).alias("p")).collect(), CHI):
        assert abs(r["p"] - p) < 1e-6


def test_chi_square_equals_the_sum_over_gamma(spark):
    cases = [(k, x) for k in (1, 2, 3, 7, 50, 333, 2000) for x in (0.01, 0.5 * k, 1.0 * k, k + 2.0, 1.3 * k + 5)]
    df = spark.createDataFrame([(x, k) for k, x in cases], "x double, k int")
    for r, (k, x) in zip(df.select(chi_square_p(F.col("x"), F.col("k")).alias("p")).collect(), cases):
        a = k / 2
        want = 1 - sum(math.exp(-x / 2 + (a + j) * math.log(x / 2) - math.lgamma(a + j + 1)) for j in range(6000))
        assert abs(r["p"] - want) < 1e-9


def test_chi_square_ends(spark):
    df = spark.createDataFrame([(0.0, 3), (5.0, 0), (float("inf"), 3), (1e4, 3)], "x double, k int")
    assert [round(r[0], 12) for r in df.select(chi_square_p(F.col("x"), F.col("k"))).collect()] == [1, 1, 0, 0]


def test_log_gamma(spark):
    df = spark.range(1, 60)
    for r in df.select("id", log_gamma_half(F.col("id").cast("int")).alias("g")).collect():
        assert abs(r["g"] - math.lgamma(r["id"] / 2)) < 1e-9


def test_kolmogorov_table(spark):
    # n = m = 2 * 10**6 makes the scaling sqrt(nm / (n + m)) a thousand
    df = spark.createDataFrame([(x / 1000,) for x, _ in KOLMOGOROV] + [(0.0,), (1.0,)], "d double")
    got = [r[0] for r in df.select(kolmogorov_p(F.col("d"), F.lit(2_000_000), F.lit(2_000_000))).collect()]
    for p, (_, want) in zip(got, KOLMOGOROV):
        assert abs(p - want) < 1e-4
    assert got[-2:] == [1.0, 0.0]


@pytest.mark.parametrize("rows,test", [(1000, "p"), (1001, "distance")])
def test_preset_chooses_by_the_size_of_the_reference(spark, rows, test):
    ref, cur = spark.range(rows).select(F.col("id").alias("v")), spark.range(3000).select(F.col("id").alias("v"))
    out = profile.drift_preset(ref, cur).first()
    assert out["threshold"] == (profile.P_VALUE_THRESHOLD if test == "p" else profile.NUM_DRIFT_THRESHOLD)


def test_small_reference_tests(spark):
    rnd = random.Random(1)
    ref = [(rnd.gauss(0, 1), rnd.choice("aab"), rnd.randint(1, 3), None, "x") for _ in range(400)]
    cur = [(rnd.gauss(0.02, 1), rnd.choice("abb"), rnd.randint(1, 3), 1.0, rnd.choice("xy")) for _ in range(900)]
    schema = "v double, c string, few long, gone double, new string"
    out = {r["column_name"]: r for r in profile.drift_preset(spark.createDataFrame(ref, schema), spark.createDataFrame(cur, schema)).collect()}
    # chi-square by hand
    share = {x: sum(r[1] == x for r in ref) / 400 for x in "ab"}
    stat = sum((sum(r[1] == x for r in cur) - 900 * share[x]) ** 2 / (900 * share[x]) for x in "ab")
    assert abs(out["c"]["statistic"] - stat) < 1e-9 and out["c"]["drifted"]
    assert abs(out["c"]["drift_score"] - math.erfc(math.sqrt(stat / 2))) < 1e-9
    # a Kolmogorov-Smirnov statistic by hand
    grid = sorted(r[0] for r in ref + cur)
    d = max(abs(sum(r[0] <= x for r in ref) / 400 - sum(r[0] <= x for r in cur) / 900) for x in grid)
    assert out["v"]["test"] == "ks" and abs(out["v"]["statistic"] - d) < 1e-12
    x = math.sqrt(400 * 900 / 1300) * d
    want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 400))
    assert abs(out["v"]["drift_score"] - want) < 1e-9
    assert out["few"]["test"] == "chi_square" and not out["few"]["drifted"]
    assert out["gone"]["drift_score"] is None and not out["gone"]["drifted"]          # no value on one side
    assert out["new"]["drift_score"] == 0 and out["new"]["drifted"]                   # a value the reference lacks
    assert abs(out["c"]["drift_share"] - sum(r["drifted"] for r in out.values()) / 5) < 1e-12
