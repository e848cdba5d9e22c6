"""Alert rules on a stream of counter scrapes (K4): closed alerts into a Parquet folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from stockpulse.operators.alerts import EVAL_STEP_SECONDS, RULES, Rule, alert_stream


def start_alerts(scraped: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes",
                 rules: Sequence[Rule] = RULES, step_seconds: int = EVAL_STEP_SECONDS, available_now: bool = True):
    """Start the query over a stream (job, ts, counters...); append mode, exactly-once file sink."""
    w = (alert_stream(scraped, watermark, rules, step_seconds).writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
