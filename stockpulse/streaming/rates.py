"""Streaming form of the sliding call rate (K3) and failure share (K4 input).

Event-time sliding windows with a watermark, append mode: a window is
emitted once the watermark passes its end, and its state is then dropped, so
state stays bounded by (late-data allowance / slide) windows per label no
matter how long the stream runs. Output rows equal the batch
`monitoring.sliding_counts` for every emitted window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpulse.operators.monitoring import EVAL_STEP, RATE_RANGE, RATE_RANGE_SECONDS


def sliding_rates(stream: DataFrame, label: str, watermark: str = "10 minutes",
                  range_=RATE_RANGE, step=EVAL_STEP) -> DataFrame:
    """Calls, failures and rate per (sliding window, label) on a stream with
    columns ts, `label`, ok."""
    return (stream.withWatermark("ts", watermark)
            .groupBy(F.window("ts", range_, step).alias("w"), label)
            .agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), label,
                    "calls", "failures", (F.col("calls") / float(RATE_RANGE_SECONDS)).alias("rate")))


def start_rates(stream: DataFrame, label: str, path: str, checkpoint: str, available_now: bool = True,
                watermark: str = "10 minutes"):
    """Append closed windows to a Parquet folder (exactly-once file sink)."""
    w = (sliding_rates(stream, label, watermark).writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
