"""Landing loads.

Keyed full-refresh loads keep the first copy of a key. "First" is the ingest
position, taken from `position_col` (a column the caller supplies, e.g. a
file offset or load sequence) - never from physical partition order, which a
retried task may change. Dedup is a `min_by` aggregate: partial on the map
side, so a key with millions of copies is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.functions.parsing import row_hash, sanitize_landing_name, to_timestamp_lenient


def keyed_first_wins(df: DataFrame, key: list[str], position_col: str) -> DataFrame:
    """One row per key, the one with the smallest position."""
    payload = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in payload])
    # rows without a position come after all others
    order = F.struct(F.col(position_col).isNull(), F.col(position_col))
    out = df.groupBy(*key).agg(F.min_by(packed, order).alias("__row"))
    return out.select(*key, *[F.col(f"__row.{c}").alias(c) for c in payload])


def with_row_hash(df: DataFrame) -> DataFrame:
    """Add `row_hash` over all columns, the parsed time as text too."""
    return df.withColumn("row_hash", row_hash(df.columns))


def load_transactions(df: DataFrame) -> DataFrame:
    """B2: landing load keyed on (row_hash, transaction_time). Rows of one key
    are equal but for missing values and the text 'nan', which hash alike; one of
    them is kept, with NULL where any copy has it. Grouping by the hashed values with
    flags as aggregates stays a hash aggregate, combined before the shuffle."""
    if "transaction_time" not in df.columns:
        raise ValueError("'transaction_time' column missing in transactions input")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    keys = [F.coalesce(F.col(c), F.lit("nan")).alias(c) if c in texts else F.col(c) for c in df.columns]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"), *[F.max(F.col(c).isNull()).alias(f"__null_{c}") for c in texts])
    return with_row_hash(one.select(*[F.when(~F.col(f"__null_{c}"), F.col(c)).alias(c) if c in texts else F.col(c)
                                      for c in df.columns]))


def landing_schema(columns, time_cols=("transaction_time",)) -> T.StructType:
    """All text except the time columns (A1/A2 landing types)."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def read_csv_landing(spark: SparkSession, path: str, columns=None, required=(),
                     time_cols=("transaction_time",)) -> DataFrame:
    """A1 / A2: CSV with header, read as text (no inference), names
    normalised (C1), required columns checked, time columns parsed (J9)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(landing_schema(columns)).csv(path) if columns else \
        reader.option("inferSchema", False).csv(path)
    df = df.toDF(*[sanitize_landing_name(c) for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df.select(*[to_timestamp_lenient(F.col(c)).alias(c) if c in time_cols else F.col(c)
                       for c in df.columns])
