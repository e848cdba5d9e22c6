"""Zone tables that are reloaded in parts or kept in the catalog.

* `reload_partitions` replaces only the partitions that the new rows fall in (dynamic
  overwrite). The rows are rebalanced on the partition column first, so a partition is
  written as one file, or a few where it is large, not as one per task.
* `save_table` is a catalog table with a declared schema, bucketed and sorted by its series key:
  windows, joins and aggregates on that key read it without an exchange.
* `counted` takes row counts from the write itself instead of reading the table again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.sources.io import ensure_database


def reload_partitions(df: DataFrame, path: str, by: str, sort_within: Sequence[str] = ()) -> str:
    """B2: write `df` under folders by=<value>; folders without new rows stay as they are."""
    out = df.hint("rebalance", by)
    if sort_within:
        out = out.sortWithinPartitions(by, *sort_within)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))
    return path


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The partitioned folder with its declared schema; filters on the partition column prune folders."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def save_table(df: DataFrame, database: str, name: str, schema: T.StructType, bucket_by: Sequence[str],
               sort_by: Sequence[str], path: str, buckets: int | None = None) -> str:
    """Full refresh of the catalog table `database`.`name` in the declared schema
    (a column of another type is an error, not a cast), bucketed and sorted. Returns its name."""
    spark = df.sparkSession
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name}: declared {f.dataType.simpleString()}, got {have[f.name].simpleString() if f.name in have else 'nothing'}"
             for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong or len(have) != len(schema.fields):
        raise ValueError(f"{name}: {'; '.join(wrong) or 'more columns than declared'}")
    ensure_database(spark, database)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = f"`{database}`.`{name}`"
    spark.sql(f"DROP TABLE IF EXISTS {full}")
    # one file per bucket: the rows are dealt to the buckets' own hash before the write
    (df.select(*schema.names).repartition(n, *bucket_by).write.mode("overwrite").bucketBy(n, *bucket_by)
     .sortBy(*sort_by).option("path", path).format("parquet").saveAsTable(f"{database}.{name}"))
    return full


def counted(df: DataFrame, write: Callable[[DataFrame], object], **metrics: Column) -> dict[str, int]:
    """Row count of `df` and further aggregates, taken from the write that `write` makes of it."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]))
    got = seen.get
    return {n: int(got.get(n) or 0) for n in ("rows", *metrics)}
