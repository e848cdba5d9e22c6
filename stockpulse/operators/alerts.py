"""Alert rules over counters (K4, F17): evaluated from a rule table.

A scrape log has one row per (job, evaluation time) with the counters' totals at that time. A
rule compares one counter, or the ratio of two, with a limit; it must hold for
some seconds before it fires. Rules are data: `evaluations` turns every scrape into one
row per rule, so a new rule needs no new code.

An alert is an island of evaluations, `step` apart, at which its rule holds. It is pending
from the first, firing from the first evaluation at which it has held long enough, and
resolved (or, if it never fired, inactive) at the first evaluation after the island. A
missing evaluation ends an island as a false one does.

Windows run over one job's scrapes (jobs x minutes of the calendar, however many calls
were counted); the calls themselves are only counted, with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVAL_STEP_SECONDS = 60


@dataclass(frozen=True)
class Rule:
    alert: str
    severity: str
    counter: str
    per: str | None            # counter it is divided by
    above: float
    hold_seconds: int

    def holds(self) -> Column:
        value = F.col(self.counter)
        if self.per is not None:
            value = value / F.nullif(F.col(self.per), F.lit(0))
        return F.coalesce(value > self.above, F.lit(False))


# The four rules.
RULES = (
    Rule("PipelineFailed", "critical", "pipeline_failures_total", None, 0, 5),
    Rule("TrainingFailed", "critical", "training_failure_total", None, 0, 5),
    Rule("DataDriftDetected", "warning", "drift_detected_total", None, 0, 5),
    Rule("PipelineHighFailureRate", "warning", "pipeline_failures_total", "pipeline_runs_total", 0.2, 10),
)


def scrapes(increments: DataFrame, job: str, ts: str, counters: Sequence[str], restart: str = "day",
            step_seconds: int = EVAL_STEP_SECONDS) -> DataFrame:
    """(job, ts, counters...): the counters' totals at every step from a job's first to its last
    increment, counted from the last restart of the process (every `restart`). `increments`
    has one row per counted call with what it adds to each counter."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step_seconds) * step_seconds)
    per = increments.groupBy(F.col(job).alias("job"), slot.alias("ts")).agg(*[F.sum(c).alias(c) for c in counters])
    grid = per.groupBy("job").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        "job", F.explode(F.sequence("lo", "hi", F.expr(f"interval {step_seconds} seconds"))).alias("ts"))
    since = (Window.partitionBy("job", F.date_trunc(restart, "ts")).orderBy("ts")
             .rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(per, ["job", "ts"], "left").select(
        "job", "ts", *[F.coalesce(F.sum(c).over(since), F.lit(0)).alias(c) for c in counters])


def evaluations(scraped: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(job, ts, alert, severity, hold_seconds, holds): every rule at every scrape."""
    each = [F.struct(F.lit(r.alert).alias("alert"), F.lit(r.severity).alias("severity"),
                     F.lit(r.hold_seconds).alias("hold_seconds"), r.holds().alias("holds")) for r in rules]
    return scraped.select("job", "ts", F.inline(F.array(*each)))


def _named(islands: DataFrame, closed: Column, step_seconds: int) -> DataFrame:
    """Islands (job, alert, severity, hold_seconds, start, end, evaluations) as alerts."""
    held = F.unix_seconds("end") - F.unix_seconds("start")
    fired = held >= F.col("hold_seconds")
    wait = F.ceil(F.col("hold_seconds") / step_seconds) * step_seconds
    return islands.select(
        "alert", "severity", "job", F.col("start").alias("pending_at"),
        F.when(fired, F.timestamp_seconds(F.unix_seconds("start") + wait)).alias("firing_at"),
        F.when(closed, F.timestamp_seconds(F.unix_seconds("end") + step_seconds)).alias("resolved_at"),
        "evaluations", F.when(closed & fired, "resolved").when(closed, "inactive").when(fired, "firing")
        .otherwise("pending").alias("state"))


def alert_history(scraped: DataFrame, rules: Sequence[Rule] = RULES, step_seconds: int = EVAL_STEP_SECONDS) -> DataFrame:
    """K4: every alert with its times and its state at the last scrape of all jobs."""
    last = scraped.agg(F.max("ts")).first()[0]
    w = Window.partitionBy("alert", "job").orderBy("ts")
    seconds = F.unix_seconds("ts")
    x = evaluations(scraped, rules).where("holds")
    fresh = F.coalesce(seconds - F.lag(seconds).over(w) > step_seconds, F.lit(True)).cast("int")
    islands = (x.withColumn("fresh", fresh)
               .withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("alert", "severity", "hold_seconds", "job", "island")
               .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("evaluations")))
    return _named(islands, F.col("end") < F.lit(last), step_seconds)


def alert_stream(scraped: DataFrame, watermark: str, rules: Sequence[Rule] = RULES,
                 step_seconds: int = EVAL_STEP_SECONDS) -> DataFrame:
    """K4 on a stream of scrapes: islands are session windows whose gap is one and a half steps, so
    the next evaluation joins and the one after it does not. Append mode gives an alert when
    the watermark has passed its island; open islands are the only state."""
    gap = f"{step_seconds * 3 // 2} seconds"
    x = evaluations(scraped.withWatermark("ts", watermark), rules).where("holds")
    islands = (x.groupBy(F.session_window("ts", gap).alias("s"), "alert", "severity", "hold_seconds", "job")
               .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("evaluations")))
    return _named(islands, F.lit(True), step_seconds)


def totals(increments: DataFrame, job: str, counters: Sequence[str]) -> DataFrame:
    """the counters per job over all time."""
    return increments.groupBy(F.col(job).alias("job")).agg(*[F.sum(c).alias(c) for c in counters])
