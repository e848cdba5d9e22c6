"""Mixing sources to target weights by capped water-filling.

A source's size is the words of its documents. The mix has `budget` times all
words; a source asks for its weight's share, is clamped at `max_epochs` times its
size, and what is clamped off goes to the others by weight until none is above. That
is the level L with sum(min(cap, weight * L)) = budget: sources are sorted by cap /
weight and L follows from running sums, without rounds.

Every document is taken floor(target / size of its source) times; the fractional
repetition goes to documents in the order of a seeded hash of their id until the
source's target is reached as nearly as a whole document allows. That order's running
sum is found through two levels of hash buckets and, in the last bucket, over range
partitions, so no task holds a source, nor the documents of one repeated or null id.
DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own, last
in order; a null id hashes like the text `null`; of documents with equal ids the
smaller is asked first, then the one whose text has the smaller hash, and rows equal
in id and text are asked in the order of the table; sources of size 0 and
documents of size 0 take nothing; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockpulse.llm.scratch import unused, written
from stockpulse.operators.cumulative import running_sums

WEIGHTS = (5, 2, 1)          # sources in code point order, repeating
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix"
BUCKETS = 4096               # per level
WORD = r"[^\x20\x09-\x0D]+"
MAX_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus weight and target. Works on one row per
    source; positions and running sums are taken over range partitions."""
    last = F.col("source").isNull().alias("n")
    ranked = running_sums(
        sizes.select("source", "source_size", F.struct(last, "source").alias("o"), F.lit(0).alias("g"),
                     F.lit(1).cast("long").alias("one")), "g", "o", ["one", "source_size"])
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(pattern, ((F.col("cum_one") - 1) % len(weights) + 1).cast("int"))
    src = ranked.select("g", "source", "source_size", F.col("total_source_size").alias("words"), weight.alias("weight"),
                        (max_epochs * F.col("source_size")).cast("double").alias("cap"))
    level = running_sums(src.withColumn("o", F.struct((F.col("cap") / F.col("weight")).alias("r"), last, "source")),
                         "g", "o", ["cap", "weight"])
    # the level if all sources before this one are clamped: num / den
    level = (level.withColumn("num", F.lit(float(budget)) * F.col("words") - (F.col("cum_cap") - F.col("cap")))
             .withColumn("den", F.col("total_weight") - (F.col("cum_weight") - F.col("weight"))))
    open_ = level.filter("num * weight <= cap * den").groupBy("g").agg(F.min(F.struct("o", "num", "den")).alias("at"))
    free = F.col("at").isNotNull() & (F.col("o") >= F.col("at.o"))
    return (level.join(F.broadcast(open_), "g", "left")             # one row
            .select("source", "source_size", "weight",
                    F.when(free, F.least("cap", F.col("weight") * F.col("at.num") / F.col("at.den")))
                    .otherwise(F.col("cap")).alias("target")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(id_col: Column, seed: str = SEED) -> Column:
    """60 bits of MD5, the same in any SQL engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _cut(sums: DataFrame, bucket: str, need: DataFrame) -> DataFrame:
    """First bucket of each source whose running size passes `rem`:
    (source, cut, rem left at its start). sums has BUCKETS rows a source at most."""
    w = Window.partitionBy("source").orderBy(bucket)
    run = (sums.join(need, sums["source"].eqNullSafe(need["_source"]))
           .withColumn("cum", F.sum("size").over(w)))
    return (run.filter("cum > rem").groupBy("source")
            .agg(F.min_by(F.struct(F.col(bucket).alias("cut"), (F.col("rem") - F.col("cum") + F.col("size")).alias("rem")),
                          bucket).alias("c")).select("source", "c.cut", "c.rem"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        keep: list[str] | None = None, weights=WEIGHTS, budget: float = BUDGET,
        max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The columns `keep` of docs (all by default) plus size, source_size, target,
    copies (whole and fractional repetitions taken) and taken (words)."""
    keep = docs.columns if keep is None else keep
    rows = written(docs.select(F.struct(*keep).alias("row"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"), order_hash(F.col(id_col), seed).alias("h"),
                               F.xxhash64(text_col).alias("x"), F.monotonically_increasing_id().alias("line")),
                   "mix-rows")
    rows = (rows.withColumn("b1", F.shiftright("h", 48)).withColumn("b2", F.shiftright("h", 36).bitwiseAND(BUCKETS - 1)))
    sums = written(rows.groupBy("source", "b1").agg(F.sum("size").alias("size")), "mix-buckets")
    sizes = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(source_targets(sizes, weights, budget, max_epochs)
                   .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                               .otherwise(F.lit(0)).cast("long"))
                   .withColumn("rem", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    small = plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    side = F.broadcast if small else (lambda x: x)
    first = _cut(sums, "b1", plan.select(F.col("source").alias("_source"), "rem"))
    inside = (rows.select("source", "size", "h", "b1", "b2")
              .join(side(first.select(F.col("source").alias("_source"), F.col("cut").alias("_cut"), F.col("rem"))),
                    F.col("source").eqNullSafe(F.col("_source")) & (F.col("b1") == F.col("_cut"))))
    second = _cut(inside.groupBy("source", "b2").agg(F.sum("size").alias("size")), "b2",
                  first.select(F.col("source").alias("_source"), "rem"))
    plan = (plan.alias("p")
            .join(first.select(F.col("source").alias("s1"), F.col("cut").alias("cut1")),
                  F.col("source").eqNullSafe(F.col("s1")), "left")
            .join(second.select(F.col("source").alias("s2"), F.col("cut").alias("cut2"), F.col("rem").alias("rem2")),
                  F.col("source").eqNullSafe(F.col("s2")), "left")
            .select(F.col("source").alias("_source"), "source_size", "target", "whole", "cut1", "cut2", "rem2"))
    plan = written(plan, "mix-plan")
    named = rows.join(side(plan), F.col("source").eqNullSafe(F.col("_source")))
    at_cut = (F.col("b1") == F.col("cut1")) & (F.col("b2") == F.col("cut2"))
    before = (F.col("b1") < F.col("cut1")) | ((F.col("b1") == F.col("cut1")) & (F.col("b2") < F.col("cut2")))
    cols = ["row", "size", "source_size", "target", "whole"]
    # equal sources are one group, null included; `line` sets equal rows apart
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("g")
    order = F.struct("h", "size", "x", "line").alias("o")
    clear = (named.filter(~F.coalesce(at_cut, F.lit(False)))
             .select(*cols, F.coalesce(before, F.lit(False)).cast("long").alias("extra")))
    # the few documents of the last bucket, in order; nearest to the target wins
    edge = (running_sums(named.filter(at_cut).select(*cols, "rem2", group, order), "g", "o", ["size"])
            .select(*cols, (2 * F.col("cum_size") - F.col("size") < 2 * F.col("rem2")).cast("long").alias("extra")))
    out = clear.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    names = []
    for c in ("size", "source_size", "target", "copies", "taken"):
        names.append(unused(c, keep + names))
    return out.select(*[F.col("row")[c].alias(c) for c in keep],
                      F.col("size").alias(names[0]), F.col("source_size").alias(names[1]),
                      F.col("target").alias(names[2]), F.col("copies").alias(names[3]),
                      (F.col("size") * F.col("copies")).alias(names[4]))
