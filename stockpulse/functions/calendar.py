"""Calendar columns (J1-J8). All built-in expressions, inside codegen.

Two conventions exist in the reference and both are kept:
training side  : dow 1=Mon..7=Sun, week = Sunday-start week of year 0..53 (strftime %U)
forecast side  : dow 0=Mon..6=Sun, week = ISO week
`calendar_columns(..., convention=...)` picks one; `TRAINING` is the default
because it is what the feature tables store.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAINING = "training"
FORECAST = "forecast"


def day_of(ts: Column) -> Column:
    """Calendar day of a timestamp."""
    return F.to_date(ts)


def dow_iso(d: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(d) + 1).cast("int")


def dow_zero(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(d).cast("int")


def is_weekend(d: Column) -> Column:
    """1 on Saturday/Sunday."""
    return (F.weekday(d) >= 5).cast("int")


def week_sunday_start(d: Column) -> Column:
    """Week of year with weeks starting on Sunday, 0..53 (%U)."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def week_iso(d: Column) -> Column:
    """ISO-8601 week number."""
    return F.weekofyear(d).cast("int")


def calendar_columns(d: Column, convention: str = TRAINING) -> list[Column]:
    if convention == TRAINING:
        dow, week = dow_iso(d), week_sunday_start(d)
    elif convention == FORECAST:
        dow, week = dow_zero(d), week_iso(d)
    else:
        raise ValueError(convention)
    return [dow.alias("dow"), is_weekend(d).alias("is_weekend"),
            week.alias("week_of_year"), F.month(d).cast("int").alias("month")]


# DuckDB twins for the oracle.
SQL_DOW_ISO = "CAST(isodow({d}) AS INTEGER)"
SQL_DOW_ZERO = "CAST(isodow({d}) - 1 AS INTEGER)"
SQL_WEEKEND = "CAST(isodow({d}) IN (6, 7) AS INTEGER)"
SQL_WEEK_SUN = "CAST(strftime({d}, '%U') AS INTEGER)"
SQL_WEEK_ISO = "CAST(weekofyear({d}) AS INTEGER)"
SQL_MONTH = "CAST(month({d}) AS INTEGER)"


def sql_calendar(d: str, convention: str = TRAINING) -> str:
    if convention == TRAINING:
        dow, week = SQL_DOW_ISO, SQL_WEEK_SUN
    else:
        dow, week = SQL_DOW_ZERO, SQL_WEEK_ISO
    return ", ".join([dow.format(d=d) + " AS dow", SQL_WEEKEND.format(d=d) + " AS is_weekend",
                      week.format(d=d) + " AS week_of_year", SQL_MONTH.format(d=d) + " AS month"])
