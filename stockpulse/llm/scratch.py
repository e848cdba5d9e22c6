"""Intermediate tables in the shared folder, and small session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stockpulse.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back. It cuts the
    lineage, survives lost executors, and keeps column pruning. The folder is
    new for each call and goes when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, taken: list[str]) -> str:
    """`name`, with underscores added until no column in `taken` has it
    (column names are compared without regard to case, as Spark does)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
