"""The online store (K1): the latest row per key, merged bucket by bucket.

Keys are dealt to a fixed number of hash buckets. A version of the store is a manifest, one row
per bucket with the folder that holds it. A merge reads only the buckets that the new rows
touch, writes these anew and gives the next manifest, which takes every other bucket
over as it is: the cost of a micro-batch follows its own keys, not the size of the store.

    data/v=<batch>/bucket=<b>/part-*      one file per touched bucket
    manifest/v=<batch>/                   (bucket, folder); its _SUCCESS commits the version

Replaying a batch starts from the newest manifest below it and writes the same
version again, so nothing changes. Readers resolve the newest complete manifest; folders that
none of the last `keep` manifests names are deleted, so a reader of the version before is safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.operators.pointintime import latest_per_key
from stockpulse.sources.io import complete_marks, delete_path, path_exists

MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])


@dataclass
class OnlineStore:
    """Key, timestamp, value columns and the optional created column of the rows; `buckets` may not
    change during the life of a store (it is part of where a key lies)."""

    base: str                       # shared folder
    key: str
    ts: str
    cols: list[str]
    created: str | None = None
    buckets: int = 64
    keep: int = 2                   # manifests whose folders stay

    @property
    def columns(self) -> list[str]:
        more = [self.created] if self.created and self.created not in self.cols else []
        return [self.key, self.ts, *[c for c in self.cols if c != self.ts], *more]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    # ---------------------------------------------------------------- versions

    def versions(self, spark: SparkSession) -> list[int]:
        return complete_marks(spark, f"{self.base}/manifest", "v=")

    def manifest(self, spark: SparkSession, version: int | None = None, below: int | None = None) -> dict[int, str]:
        """bucket -> folder of a version (default: the newest, or the newest below `below`)."""
        found = [v for v in self.versions(spark) if below is None or v < below]
        version = version if version is not None else (found[-1] if found else None)
        if version is None:
            return {}
        rows = spark.read.schema(MANIFEST).parquet(f"{self.base}/manifest/v={version}").collect()   # a row per bucket
        return {r["bucket"]: r["folder"] for r in rows}

    # ---------------------------------------------------------------- reading

    def _rows(self, spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.base}/{f}" for f in folders])

    def read(self, spark: SparkSession, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The latest row of every key; an empty frame before the first merge."""
        folders = list(self.manifest(spark, version).values())
        schema = T.StructType([schema[c] for c in self.columns])
        return self._rows(spark, folders, schema) if folders else spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame, schema: T.StructType) -> DataFrame:
        """E6 on the store: `keys` with their rows (NULL for unknown keys), reading only
        the buckets that the keys fall in."""
        spark = keys.sparkSession
        wanted = {r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect()}
        folders = [f for b, f in self.manifest(spark).items() if b in wanted]
        schema = T.StructType([schema[c] for c in self.columns])
        stored = self._rows(spark, folders, schema) if folders else spark.createDataFrame([], schema)
        return keys.join(stored, self.key, "left")

    # ---------------------------------------------------------------- merging

    def merge(self, rows: DataFrame, version: int) -> list[int]:
        """Fold rows into the store as `version`; returns the touched buckets. A late row never
        replaces a newer stored one. Versions are the numbers of the micro-batches."""
        spark = rows.sparkSession
        before = self.manifest(spark, below=version)
        fresh = latest_per_key(rows.select(*self.columns), self.key, self.ts, self.cols, self.created).select(*self.columns)
        path = f"{self.base}/data/v={version}"
        # the micro-batch is reduced once, before the stored rows are read
        fresh = fresh.withColumn("__bucket", self.bucket())
        staged = f"{self.base}/staged/v={version}"
        fresh.write.mode("overwrite").parquet(staged)
        fresh = spark.read.schema(fresh.schema).parquet(staged)
        touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())       # at most `buckets` rows
        delete_path(spark, path)           # what a run that was cut off left
        if touched:
            stored = [before[b] for b in touched if b in before]
            merged = fresh.drop("__bucket")
            if stored:
                merged = latest_per_key(self._rows(spark, stored, merged.schema).unionByName(merged),
                                        self.key, self.ts, self.cols, self.created).select(*self.columns)
            (merged.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(path))
        now = before | {b: f"data/v={version}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.base}/manifest/v={version}")
        delete_path(spark, staged)
        self._retire(spark)
        return touched

    def _retire(self, spark: SparkSession) -> None:
        """Deletes manifests before the last `keep` and the folders that no kept one names."""
        versions = self.versions(spark)
        kept = versions[-self.keep:]
        used = {f for v in kept for f in self.manifest(spark, v).values()}
        gone: set[str] = set()
        for v in versions[:-self.keep]:
            gone |= set(self.manifest(spark, v).values()) - used
            delete_path(spark, f"{self.base}/manifest/v={v}")
        for f in sorted(gone):
            delete_path(spark, f"{self.base}/{f}")
        for v in {f.split("/")[1] for f in gone}:
            if not any(u.startswith(f"data/{v}/") for u in used) and path_exists(spark, f"{self.base}/data/{v}"):
                delete_path(spark, f"{self.base}/data/{v}")
