"""Readers and writers around the zones.

Every reader takes a declared schema (no inference: a full extra pass over
the data and unstable types at scale). Writers are overwrite/append of
Parquet or CSV folders; the committer's `_SUCCESS` file is the completion
marker (B18).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Conditions that say a source is not there.
ABSENT = {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND"}


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A written folder is complete when the committer left `_SUCCESS`."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def complete_marks(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders `<prefix><number>` under path, ascending."""
    sc = spark.sparkContext
    path_of = sc._jvm.org.apache.hadoop.fs.Path
    p = path_of(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(int(st.getPath().getName()[len(prefix):]) for st in fs.listStatus(p)
                  if st.getPath().getName().startswith(prefix) and fs.exists(path_of(st.getPath(), "_SUCCESS")))


def kept_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The finished table at `path`, built and written only where it is missing or
    unfinished (no completion marker, so a lost writer is written over)."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_zone(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A4: zone table; a missing table is an empty DataFrame with the declared
    schema (the caller's step then has nothing to do). Any other fault is raised:
    a permission or file-system error must not empty the zone after it."""
    if not path_exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def first_resolving(spark: SparkSession, candidates: Sequence[dict]) -> DataFrame:
    """A3: ordered sources ({format, path | table, options}); the first that
    resolves (schema known, path present) is read. JDBC candidates take
    `url`/`dbtable` options plus `partitionColumn`/`lowerBound`/`upperBound`/
    `numPartitions` so the read is split across tasks. Only a source that does not exist gives way to
    the next one; any other fault (permissions, a broken file, a refused login) is raised."""
    errors = []
    for c in candidates:
        try:
            if "table" in c:
                return spark.table(c["table"])
            reader = spark.read.format(c.get("format", "parquet")).options(**c.get("options", {}))
            if c.get("schema") is not None:
                reader = reader.schema(c["schema"])
            df = reader.load(c["path"]) if "path" in c else reader.load()
            df.schema  # noqa: B018 - forces resolution
            return df
        except AnalysisException as e:
            if e.getCondition() not in ABSENT:
                raise
            errors.append(f"{c}: {e.getCondition()}")
    raise ValueError("no source resolved: " + "; ".join(errors))


def describe_schema(df: DataFrame) -> DataFrame:
    """(column_name, data_type, nullable) - the DESCRIBE of a frame."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A7 (strict: a malformed line fails the read) / A10 (missing -> empty)."""
    if not path_exists(spark, path):
        return empty(spark, schema)
    return (spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
            .schema(schema).csv(path))


def write_csv(df: DataFrame, path: str, order_by: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """CSV folder with a header. With `order_by`
    the rows are range-partitioned and sorted, so part files concatenate in
    order (a global order without collecting to one task)."""
    if order_by:
        df = df.orderBy(*order_by)
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                sort_within: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> str:
    """Parquet folder. `cluster_by` hash-partitions on
    the keys (co-located files per key), `sort_within` sorts each file so
    row-group statistics prune on the sort key (the MergeTree sort-key
    analogue), `partition_by` adds directory partitions (time partitions)."""
    if cluster_by:
        df = df.repartition(*cluster_by)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_if_rows(df: DataFrame, path: str, **kw) -> bool:
    """Write only when there is at least one row (one `isEmpty` probe)."""
    if df.isEmpty():
        return False
    write_table(df, path, **kw)
    return True


def append_with_created_at(df: DataFrame, path: str, created_col: str = "created_at") -> str:
    """Append rows with a default `created_at` = now."""
    df.withColumn(created_col, F.current_timestamp()).write.mode("append").parquet(path)
    return path


def ensure_database(spark: SparkSession, name: str) -> None:
    """CREATE DATABASE IF NOT EXISTS."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def jdbc_options(url: str, table: str, batch_size: int = 10_000, **extra) -> dict:
    """JDBC write/read options with the reference's batch size."""
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), **extra}
