"""Readers, writers and schema helpers
and the staged run (L14)."""

import datetime as dt
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from stockpulse.operators import cleaning, evaluation as ev
from stockpulse.session import scratch_path
from stockpulse.sources import io

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def _fresh(spark, what):
    return scratch_path(spark, f"test_io/{what}/{uuid.uuid4().hex}")


def test_zone_and_optional_csv_missing_is_empty(spark):
    p = _fresh(spark, "missing")
    assert io.read_zone(spark, p, SCHEMA).count() == 0
    assert io.read_zone(spark, p, SCHEMA).schema == SCHEMA
    assert io.read_csv(spark, p, SCHEMA).count() == 0


def test_zone_faults_are_raised(spark, tmp_path):
    bad = tmp_path / "zone"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        io.read_zone(spark, str(bad), SCHEMA).collect()


def test_write_if_rows_and_completion_marker(spark):
    p = _fresh(spark, "rejects")
    assert io.write_if_rows(spark.createDataFrame([], SCHEMA), p) is False
    assert not io.path_exists(spark, p)
    assert io.write_if_rows(spark.createDataFrame([(1, "x")], SCHEMA), p) is True
    assert io.is_complete(spark, p)
    assert io.read_zone(spark, p, SCHEMA).collect()[0]["b"] == "x"


def test_first_resolving_falls_through(spark):
    good = _fresh(spark, "good")
    spark.createDataFrame([(1, "x")], SCHEMA).write.parquet(good)
    df = io.first_resolving(spark, [{"format": "parquet", "path": _fresh(spark, "nope")},
                                    {"format": "parquet", "path": good}])
    assert df.count() == 1
    with pytest.raises(ValueError):
        io.first_resolving(spark, [{"format": "parquet", "path": _fresh(spark, "nope")}])


def test_strict_csv_fails_on_bad_line(spark):
    p = _fresh(spark, "csv")
    spark.createDataFrame([("1", "x"), ("oops", "y")], "a string, b string").write.option("header", True).csv(p)
    assert io.read_csv(spark, p, SCHEMA).where("a IS NULL").count() == 1     # permissive: NULL
    with pytest.raises(Exception):
        io.read_csv(spark, p, SCHEMA, strict=True).collect()


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 2.0, "s")], "id long, day date, v double, t string")
    assert cleaning.pick_date_column(df) == "day"
    assert cleaning.pick_date_column(df.drop("day")) is None
    assert cleaning.numeric_columns(df) == ["id", "v"]
    with pytest.raises(ValueError, match="qty_7d"):
        cleaning.require_columns(df, ["id", "qty_7d"])
    d = {r["column_name"]: r["data_type"] for r in io.describe_schema(df).collect()}
    assert d == {"id": "bigint", "day": "date", "v": "double", "t": "string"}


def test_staged_run_writes_every_stage(spark):
    from stockpulse.plans.stages import STAGES, run_stages
    base = _fresh(spark, "stages")
    log = run_stages(spark, "/root/testdata/sf0.001", base)
    states = {(r["job"], r["state"]) for r in log.read().collect()}
    assert states == {(s, st_) for s in STAGES for st_ in ("START", "COMPLETE")}
    top = spark.read.parquet(f"{base}/feature_store/sku_demand_daily_features_top_10")
    assert top.select("sku_id").distinct().count() == 10
    # a single stage can be rerun alone
    run_stages(spark, "/root/testdata/sf0.001", base, only="daily_table", run_id="again")
    assert log.read().where("run_id = 'again'").count() == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 20), st.sampled_from(["h1", "h2"])),
                min_size=1, max_size=40, unique=True))
def test_split_positions_property(spark, rows):
    """Positions equal the rank in (day, tie) order and the split keeps
    exactly floor(0.8 n) rows per key, for any input."""
    base = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(k, base + dt.timedelta(days=d), h) for k, d, h in rows],
                               "sku_id string, ds date, hospital_id string")
    got = ev.chrono_split(df, "sku_id", "ds", "hospital_id").collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["sku_id"] == key), key=lambda r: (r["ds"], r["hospital_id"]))
        n = len(mine)
        assert [r["pos"] for r in mine] == list(range(n))
        assert sum(r["is_train"] for r in mine) == int(0.8 * n)


def test_kept_table_is_built_once_and_again_when_unfinished(spark, tmp_path):
    from stockpulse.sources import io
    path, built = f"{tmp_path}/kept", []

    def build():
        built.append(1)
        return spark.range(len(built), 10).toDF("x")
    assert io.kept_table(spark, path, build).count() == 9
    assert io.kept_table(spark, path, build).count() == 9 and len(built) == 1
    (tmp_path / "kept" / "_SUCCESS").unlink()
    assert io.kept_table(spark, path, build).count() == 8 and len(built) == 2


def test_input_state_follows_the_files(spark, tmp_path):
    from stockpulse.sources.tables import input_state
    for name in ("nation", "part"):
        spark.range(5).write.parquet(f"{tmp_path}/{name}.parquet/k=1")
    first = input_state(spark, str(tmp_path), ["nation", "part"])
    assert input_state(spark, str(tmp_path), ["nation", "part"]) == first
    assert input_state(spark, str(tmp_path), ["nation"]) != first
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/part.parquet/k=2")
    assert input_state(spark, str(tmp_path), ["nation", "part"]) != first
