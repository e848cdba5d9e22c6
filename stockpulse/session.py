"""Session construction and the few cluster-facing settings the library reads.

Library code never hard-codes cluster sizing: it reads what the session says.
`build_session` exists for tests, the bench and local runs; on a cluster the
caller's session is used as is.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. UTC keeps `to_date` and the oracle aligned;
# AQE re-plans joins and partition counts from runtime statistics, splits
# skewed shuffle partitions and turns small sort-merge sides into broadcasts.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "stockpulse") -> SparkSession:
    """Local/test session. On a cluster, pass your own session to the library."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(parts))
               .config("spark.default.parallelism", str(parts))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
               .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
               # single-host session: no reason to hold tasks back for locality
               .config("spark.locality.wait", "0s")
               # drop checkpoint files once nothing references them any more
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in CORE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_core_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the operators assume (idempotent)."""
    for k, v in CORE_CONF.items():
        spark.conf.set(k, v)


_conf_lock = threading.RLock()


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]):
    """The session's SQL settings while one action runs, as they were afterwards. One such
    action at a time, so that none restores the settings of another."""
    with _conf_lock:
        before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def side_by_side(*actions: Callable[[], object]) -> None:
    """Run actions that do not need each other's results at the same time: the last tasks of one and
    the small jobs of another then leave no cores idle. All end before the first fault is raised."""
    with ThreadPoolExecutor(len(actions)) as pool:
        started = [pool.submit(a) for a in actions]
    for a in started:
        a.result()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    return sc.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's `spark.checkpoint.dir`. Where it is unset, the home
    folder of the default file system serves; a private folder of this machine
    only for a local master, whose tasks all run here."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if d is None and _one_machine(sc):
        d = tempfile.mkdtemp(prefix="stockpulse-ckpt-")
    elif d is None:
        fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"{fs.getHomeDirectory().toString()}/stockpulse-checkpoints"
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def _one_machine(sc) -> bool:
    return sc.master.split("[")[0] == "local"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate
    tables (lineage cuts, versioned 'latest' tables)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    # the configured folder is stable across sessions (SparkContext adds a
    # per-application subfolder for RDD checkpoints); fall back to that one
    base = (configured or ensure_checkpoint_dir(spark)).rstrip("/")
    return f"{base}/stockpulse/{name}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder, deleted when the session's file system closes."""
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    delete_at_end(spark, path)
    return path


def written_table(df, name: str):
    """Write `df` once in the shared folder and read it back. The folder is new
    for each call and is deleted when the session's file system closes."""
    spark = df.sparkSession
    path = run_folder(spark, f"tables/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    functions of it run on executors where it is not installed (Spark's own file
    server distributes the archive), and bound the batches they get."""
    sc = spark.sparkContext
    # rows of a document table are large: smaller batches bound a worker's memory
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if _shipped.get("to") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stockpulse-src-"), "stockpulse.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped["to"] = sc.applicationId


_shipped: dict[str, str] = {}


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.
    The input is persisted first, so writing the checkpoint does not compute
    it a second time; the cache is dropped once the files are written (the
    result reads from the checkpoint files, which survive executor loss)."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
