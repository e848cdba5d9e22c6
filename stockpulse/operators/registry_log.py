"""Model registry as an append-only log of transitions.

Every change is a commit: a Parquet folder of events (register, promote, archive, tag), made
visible by creating the file `commits/<n>` that names it. The number is claimed with a create
that fails if the file exists, so of two writers that read the same state one wins and the
other reads again and commits after it: no version is given twice, none is lost. Nothing is
ever rewritten; the current stage of a version is the last event that set one.

    events/<id>/part-*        the events of one commit, written completely first
    commits/<n>               text: the id

The log grows with training runs, not with data; folding it is one aggregate.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.sources.io import delete_path, path_exists

EVENTS = T.StructType([T.StructField("model_name", T.StringType()), T.StructField("version", T.IntegerType()),
                       T.StructField("event", T.StringType()), T.StructField("stage", T.StringType()),
                       T.StructField("run_id", T.StringType()), T.StructField("at_ms", T.LongType()),
                       T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
PRODUCTION, ARCHIVED = "Production", "Archived"
ATTEMPTS = 20
OPEN_SECONDS = 10          # a commit file may be empty so long before its writer counts as dead


class RegistryLog:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    # ------------------------------------------------------------- commits

    def _fs(self):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path
        return path(self.base).getFileSystem(sc._jsc.hadoopConfiguration()), path

    def _commits(self) -> list[tuple[int, str]]:
        """(number, event folder) of every commit, ascending."""
        fs, path = self._fs()
        folder = path(f"{self.base}/commits")
        if not fs.exists(folder):
            return []
        out = []
        for st in fs.listStatus(folder):
            name = st.getPath().getName()
            if not name.isdigit():
                continue
            until = time.time() + OPEN_SECONDS
            text = self._text(fs, st.getPath())
            while not text and time.time() < until:        # its writer is between create and close
                time.sleep(0.1)
                text = self._text(fs, st.getPath())
            out.append((int(name), text))
        return sorted(out)

    def _text(self, fs, p) -> str:
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _claim(self, n: int, folder: str) -> bool:
        fs, path = self._fs()
        try:
            stream = fs.create(path(f"{self.base}/commits/{n}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()
        return True

    def commit(self, make: Callable[[DataFrame], DataFrame]) -> int:
        """Append the events that `make` derives from the log's events; returns the commit's number.
        If another writer was faster the events are derived anew from the log with its commit."""
        for _ in range(ATTEMPTS):
            commits = self._commits()
            folder = uuid.uuid4().hex
            path = f"{self.base}/events/{folder}"
            new = make(self._read(commits))
            new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields]).write.parquet(path)
            n = commits[-1][0] + 1 if commits else 0
            if self._claim(n, folder):
                return n
            delete_path(self.spark, path)
        raise RuntimeError(f"no commit in {ATTEMPTS} attempts")

    def _read(self, commits: list[tuple[int, str]]) -> DataFrame:
        """Events with the number `n` of their commit."""
        known = [(n, f) for n, f in commits if f and path_exists(self.spark, f"{self.base}/events/{f}")]
        if not known:
            return self.spark.createDataFrame([], EVENTS).withColumn("n", F.lit(0))
        rows = self.spark.read.schema(EVENTS).parquet(*[f"{self.base}/events/{f}" for _, f in known])
        folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
        number = F.create_map(*[x for n, f in known for x in (F.lit(f), F.lit(n))])     # one entry per commit
        return rows.withColumn("n", F.element_at(number, folder))

    def events(self) -> DataFrame:
        return self._read(self._commits())

    # ------------------------------------------------------------- changes

    def register(self, models: DataFrame, run_id: str, at_ms: int, tags: dict[str, str] | None = None) -> int:
        """A new version of every model of `models` (model_name), promoted to Production; the
        versions before it that are not archived yet are archived. One commit for all of them."""
        names = models.select("model_name").where("model_name is not null").distinct()

        def make(log: DataFrame) -> DataFrame:
            state = versions_of(log)
            last = state.groupBy("model_name").agg(F.max(F.col("version").cast("int")).alias("last"))
            fresh = names.join(last, "model_name", "left").select("model_name", (F.coalesce("last", F.lit(0)) + 1).alias("version"))
            live = state.where(F.col("stage") != ARCHIVED).join(names, "model_name", "left_semi").select(
                "model_name", F.col("version").cast("int").alias("version"))

            def event(rows, kind, stage=None, key=None, value=None):
                return rows.select("model_name", "version", F.lit(kind).alias("event"), F.lit(stage).cast("string").alias("stage"),
                                   F.lit(run_id).alias("run_id"), F.lit(at_ms).cast("long").alias("at_ms"),
                                   F.lit(key).cast("string").alias("key"), F.lit(value).cast("string").alias("value"))
            out = event(fresh, "register").unionByName(event(fresh, "promote", PRODUCTION)).unionByName(event(live, "archive", ARCHIVED))
            for k, v in (tags or {}).items():
                out = out.unionByName(event(fresh, "tag", key=k, value=v))
            return out
        return self.commit(make)

    def tag(self, model: str, version: int, key: str, value: str, at_ms: int) -> int:
        row = self.spark.createDataFrame([(model, version, "tag", None, None, at_ms, key, value)], EVENTS)
        return self.commit(lambda log: row)

    # ------------------------------------------------------------- reading

    def versions(self) -> DataFrame:
        """(model_name, version, stage, run_id, last_updated_ms), as `evaluation.resolve_model` and
        `exporter_view` read them."""
        return versions_of(self.events())

    def tags(self) -> DataFrame:
        """(model_name, version, key, value): the last value of every tag."""
        t = self.events().where("event = 'tag'")
        return (t.groupBy("model_name", F.col("version").cast("string").alias("version"), "key")
                .agg(F.max_by("value", F.struct("n", "at_ms")).alias("value")))


def versions_of(events: DataFrame) -> DataFrame:
    """Events folded to the current state of every version."""
    staged = events.where("event <> 'tag'")
    order = F.struct("n", F.when(F.col("event") == "register", 0).otherwise(1))
    return (staged.groupBy("model_name", "version").agg(
        F.max_by(F.coalesce("stage", F.lit("None")), order).alias("stage"),
        F.max(F.when(F.col("event") == "register", F.col("run_id"))).alias("run_id"),
        F.max("at_ms").alias("last_updated_ms"))
        .select("model_name", F.col("version").cast("string").alias("version"), "stage", "run_id", "last_updated_ms"))
