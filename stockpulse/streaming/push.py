"""Push source: stream feature rows into the offline and the online store (K1).

`readStream` -> (duplicates dropped) -> `foreachBatch(push_batch)`:

* offline: the micro-batch is written to `offline/batch_id=<id>` with
  overwrite, so a replayed batch (foreachBatch is at-least-once) replaces
  its own earlier attempt instead of appending twice;
* online: the rows are merged into the bucketed store (`online.py`) as version
  <id>: the latest row per key by max (event_ts, created), so that a late or repeated row
  never replaces a newer one. Only the buckets of the batch's keys are read and written.

A source that delivers an event twice (a file sent again, a producer's retry) is made
exactly-once by `dropDuplicatesWithinWatermark` on the event's identity: the state holds the
identities of the last `delay` of event time, whatever the length of the stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockpulse.streaming.online import OnlineStore


@dataclass
class PushTarget:
    base: str                       # shared folder (under spark.checkpoint.dir on a cluster)
    key: str
    ts: str
    cols: list[str]
    created: str | None = None
    buckets: int = 64
    store: OnlineStore = field(init=False)

    def __post_init__(self) -> None:
        self.store = OnlineStore(f"{self.base}/online", self.key, self.ts, self.cols, self.created, self.buckets)

    @property
    def offline(self) -> str:
        return f"{self.base}/offline"


def read_online(spark: SparkSession, target: PushTarget) -> DataFrame | None:
    """The latest row per key; None before the first batch."""
    manifest = target.store.manifest(spark)
    if not manifest:
        return None
    schema = spark.read.parquet(f"{target.offline}").schema
    return target.store.read(spark, schema)


def push_batch(target: PushTarget):
    def fn(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*target.store.columns)
        path = f"{target.offline}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        # the offline copy feeds the merge, so the source is read once
        target.store.merge(batch.sparkSession.read.schema(rows.schema).parquet(path), batch_id)
    return fn


def without_repeats(stream: DataFrame, identity: list[str], ts: str, delay: str) -> DataFrame:
    """The first arrival of every event; rows later than `delay` behind the newest are dropped."""
    zoned = dict(stream.dtypes)[ts] == "timestamp"
    if zoned:
        return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(identity)
    # watermarks need zone-aware event time
    return (stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
            .dropDuplicatesWithinWatermark(identity).drop("__ts"))


def push_stream(stream: DataFrame, target: PushTarget, checkpoint: str, available_now: bool = True,
                identity: list[str] | None = None, delay: str = "1 day"):
    """Start the push query (availableNow for replays/backfills). With `identity` (the columns that
    name an event) repeated deliveries within `delay` of event time are dropped."""
    if identity:
        stream = without_repeats(stream, identity, target.ts, delay)
    w = stream.writeStream.foreachBatch(push_batch(target)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
