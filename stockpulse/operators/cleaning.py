"""Cleaning (C1-C5, C8, C12, D1, J9-J14, F5): narrow, codegen'd projections.

Every step is a column expression, so a cleaning job is one scan + one
WholeStageCodegen stage + the write; nothing is collected except the single
aggregate row that tells which columns are entirely null (C4), which decides
the output schema and so must be known before the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.functions import parsing as P


def rename(df: DataFrame, fn) -> DataFrame:
    """Apply a name normaliser to every column."""
    return df.toDF(*[fn(c) for c in df.columns])


def all_null_columns(df: DataFrame) -> list[str]:
    """C4: names of columns with no non-null value (one aggregate pass)."""
    if not df.columns:
        return []
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]


def drop_present(df: DataFrame, names) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*[c for c in names if c in df.columns])


def null_counts(df: DataFrame) -> DataFrame:
    """one row per column: (column_name, null_count), one aggregate pass."""
    aggs = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return df.agg(*aggs).selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, null_count)")


def clean_sku_master(df: DataFrame) -> DataFrame:
    """SKU master: names (C3), drop all-null columns (C4), sentinels -> NULL
    on text columns (J13), constant fills on the columns still present (J12)."""
    df = rename(df, lambda c: P.sanitize_clean_name(c, dash=False))
    df = df.drop(*all_null_columns(df))
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    df = df.select(*[P.null_sentinels(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
    fills = {k: v for k, v in P.SKU_FILLS.items() if k in df.columns}
    return df.fillna(fills) if fills else df


def clean_transactions(df: DataFrame) -> DataFrame:
    """Transactions: names (C3), parse times (J9), drop identifying columns
    (C5), numbers (J10, C8 forced to double), normalise code/type text (J14),
    keep quantity >= 0 (D1: missing and NaN are dropped)."""
    df = rename(df, lambda c: P.sanitize_clean_name(c, dash=True))
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in P.TIME_COLS:
            c = c if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else P.to_timestamp_lenient(c)
        elif f.name in P.NUMERIC_COLS:                 # a double reads back from its text as itself
            c = F.nanvl(c, F.lit(None).cast("double")) if isinstance(f.dataType, T.DoubleType) else P.to_number(c)
        elif f.name in P.TEXT_NORM_COLS:
            c = P.normalise_text(c.cast("string"))
        cols.append(c.alias(f.name))
    df = drop_present(df.select(*cols), P.DROP_COLS)
    if "quantity_consumed" in df.columns:
        df = df.where(F.col("quantity_consumed") >= 0)
    return df


def strip_zone(df: DataFrame) -> DataFrame:
    """Zone-aware timestamps -> zone-free (wall clock in the session zone)."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


# Candidate date columns, in preference order.
DATE_CANDIDATES = ["ds", "date", "day", "forecast_date"]
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def pick_date_column(df: DataFrame, candidates=DATE_CANDIDATES) -> str | None:
    """C14: the first candidate date column present (schema only)."""
    return next((c for c in candidates if c in df.columns), None)


def numeric_columns(df: DataFrame) -> list[str]:
    """C14: numeric columns only."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def require_columns(df: DataFrame, required) -> DataFrame:
    """Error naming the missing columns, else the frame unchanged."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required features: {missing}")
    return df
