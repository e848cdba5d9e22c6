"""Bounded, seeded samples of labelled rows to fit classifiers on, and the
hash folds of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def label_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y): one row per labelled id; of contradicting rows the larger label
    holds, rows without an id or label are no labels."""
    return (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
            .filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")))


def bounded_ids(rows: DataFrame, y: int, limit: int, seed: int) -> DataFrame:
    """At most `limit` (id, y) rows of class y: those whose seeded hash is least."""
    return rows.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(limit)
