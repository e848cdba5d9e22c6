"""Profiling and drift.

All statistics are distributed aggregates. Per-value counts for every column
come from one unpivot + `groupBy(column, value)` (partial aggregation absorbs a
hot value). Exact quartiles and drift need cumulative distributions; they come
from `running_sums`, which never puts a whole column in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.functions.distributions import chi_square_p, kolmogorov_p
from stockpulse.operators.cumulative import running_sums

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# Drift thresholds of the default preset.
NUM_DRIFT_THRESHOLD = 0.1       # normalised Wasserstein distance
CAT_DRIFT_THRESHOLD = 0.1       # Jensen-Shannon distance
DATASET_DRIFT_SHARE = 0.5       # share of drifted columns
STD_FLOOR = 0.001
SMALL_REFERENCE = 1000          # rows; up to here the preset tests with p-values
P_VALUE_THRESHOLD = 0.05
FEW_VALUES = 5                  # numeric columns with no more distinct reference values count as categories


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, cnt) for every column."""
    cols = cols or df.columns
    # an unpivot is generated code (an array of structs per row is not), a column's number is a short key
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(str(i)) for i, c in enumerate(cols)])
    per = (texts.unpivot([], texts.columns, "i", "value").where(F.col("value").isNotNull())
           .groupBy("i", "value").agg(F.count(F.lit(1)).alias("cnt")))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i").cast("int") + 1)
    return per.select(name.alias("column_name"), "value", "cnt")


def describe(df: DataFrame, quartiles: bool = False) -> DataFrame:
    """one row per column: count for all; unique, top, freq for
    non-numeric columns (NULL for numeric ones, as a mixed-type describe
    reports them); mean, std (sample), min, max and optionally the exact
    quartiles for numeric columns. `top` is the most frequent value; ties go
    to the smallest value. Values are counted for non-numeric columns only."""
    nums = numeric_columns(df)
    cats = [c for c in df.columns if c not in nums]
    numeric = ["mean", "std", "min", *(["q25", "q50", "q75"] if quartiles else []), "max"]
    parts = []
    if cats:
        parts.append(value_counts(df, cats).groupBy("column_name").agg(
            F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by("value", F.struct((-F.col("cnt")).alias("n"), F.col("value").alias("v"))).alias("top"),
            F.max("cnt").alias("freq")).select("*", *[F.lit(None).cast("double").alias(c) for c in numeric]))
    if nums:
        aggs = []
        for i, c in enumerate(nums):
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        stack = ", ".join(f"'{c}', n{i}, mean{i}, std{i}, min{i}, max{i}" for i, c in enumerate(nums))
        num = df.agg(*aggs).selectExpr(f"stack({len(nums)}, {stack}) AS (column_name, count, mean, std, min, max)")
        if quartiles:
            num = num.join(exact_quantiles(df, nums), "column_name", "left")
        parts.append(num.select("column_name", "count", F.lit(None).cast("long").alias("unique"),
                                F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"), *numeric))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def exact_quantiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, q25, q50, q75), exact, interpolated between neighbours:
    from the running counts of distinct values, so no column is in one task."""
    counts = _doubles(df, cols).groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(counts, "column_name", "x", ["cnt"])
    aggs = []
    for name, q in QUARTILES.items():
        at = F.lit(q) * (F.col("total_cnt") - 1)
        holds = lambda i: (F.col("cum_cnt") > i) & (F.col("cum_cnt") - F.col("cnt") <= i)
        low, high = F.max(F.when(holds(F.floor(at)), F.col("x"))), F.max(F.when(holds(F.ceil(at)), F.col("x")))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return cum.groupBy("column_name").agg(*aggs)


def _doubles(df: DataFrame, cols: list[str], *more) -> DataFrame:
    """Unpivot numeric columns to (column_name, x), non-null values only."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])
    return df.select(F.inline(pairs), *more).where(F.col("x").isNotNull())


def quality_summary(df: DataFrame) -> DataFrame:
    """F16: rows, columns, missing cells, constant columns, duplicated rows.

    Constant columns (one value, missing ones aside) have equal minimum and
    maximum; duplicated rows are counted over a 128-bit hash of the row."""
    cols = df.columns
    of = lambda c: F.col(f"`{c}`")
    missing = sum((of(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    constant = sum((F.coalesce((F.min(of(c)) == F.max(of(c))).cast("long"), F.lit(0)) for c in cols), F.lit(0).cast("long"))
    whole = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"),
                   constant.alias("constant_columns"))
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), of(c).cast("string")), F.lit("n")) for c in cols]))
    distinct = df.select(F.unhex(row).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("distinct_rows"))
    one = F.lit(1).alias("one")                                   # both sides are one row
    return (whole.select("*", one).join(distinct.select("*", one), "one")
            .select("rows", F.lit(len(cols)).alias("columns"), "missing_cells", "constant_columns",
                    (F.col("rows") - F.col("distinct_rows")).alias("duplicated_rows")))


def numeric_drift(both: DataFrame, cols: list[str]) -> DataFrame:
    """Per numeric column: Wasserstein-1 distance between the two empirical
    distributions, normalised by the reference population std (floored),
    and the Kolmogorov-Smirnov statistic max |F_ref - F_cur|. `both` has the rows of
    both inputs with a boolean `is_ref`."""
    counts = _doubles(both, cols, "is_ref").groupBy("column_name", "x").agg(
        F.count_if(F.col("is_ref")).alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur"))
    cum = (running_sums(counts, "column_name", "x", ["n_ref", "n_cur"])
           .withColumnRenamed("total_n_ref", "t_ref").withColumnRenamed("total_n_cur", "t_cur"))
    diff = F.abs(F.col("cum_n_ref") / F.col("t_ref") - F.col("cum_n_cur") / F.col("t_cur"))
    x, n, t = F.col("x"), F.col("n_ref"), F.col("t_ref")
    per = cum.select("column_name", "x", "n_ref", "t_ref", diff.alias("d"),
                     (diff * F.coalesce(F.col("next_x") - x, F.lit(0.0))).alias("area"))
    # the reference's deviation, from its counts, about the mean of the same counts
    mean = per.groupBy("column_name").agg((F.sum(x * n) / F.max(t)).alias("mean"))
    dist = (per.join(mean, "column_name").groupBy("column_name")
            .agg(F.sum("area").alias("wasserstein"), F.max("d").alias("ks_statistic"),
                 F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / F.max(t)).alias("std_ref")))
    return (dist
            .select("column_name", F.lit("numeric").alias("kind"),
                    (F.col("wasserstein") / F.greatest(F.col("std_ref"), F.lit(STD_FLOOR))).alias("drift_score"),
                    "ks_statistic", F.lit(NUM_DRIFT_THRESHOLD).alias("threshold")))


def categorical_drift(both: DataFrame, cols: list[str]) -> DataFrame:
    """Per categorical column: Jensen-Shannon distance (natural log) between
    the category shares of the two inputs (`is_ref` tells them apart)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    j = (both.select(F.inline(pairs), "is_ref").where(F.col("value").isNotNull()).groupBy("column_name", "value")
         .agg(F.count_if(F.col("is_ref")).alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur")))
    tot = j.groupBy("column_name").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    p = F.col("n_ref") / F.col("t_ref")
    q = F.col("n_cur") / F.col("t_cur")
    m = (p + q) / 2

    def kl(a):
        return F.when(a > 0, a * F.ln(a / m)).otherwise(F.lit(0.0))
    js = (j.join(tot, "column_name").groupBy("column_name")
          .agg(((F.sum(kl(p)) + F.sum(kl(q))) / 2).alias("js")))
    return js.select("column_name", F.lit("categorical").alias("kind"),
                     F.sqrt(F.greatest(F.col("js"), F.lit(0.0))).alias("drift_score"),
                     F.lit(None).cast("double").alias("ks_statistic"),
                     F.lit(CAT_DRIFT_THRESHOLD).alias("threshold"))


def _chi_square(by: str, counts: DataFrame) -> DataFrame:
    """(by, chi_square, df) from (by, value, n_ref, n_cur, t_ref, t_cur): the current counts against the
    reference's shares. A value the reference lacks makes the statistic infinite."""
    expected = F.col("n_ref").cast("double") * F.col("t_cur") / F.col("t_ref")
    part = F.when(F.col("n_ref") > 0, (F.col("n_cur") - expected) * (F.col("n_cur") - expected) / expected) \
        .otherwise(F.lit(float("inf")))
    return counts.groupBy(by).agg(F.sum(part).alias("chi_square"), (F.count(F.lit(1)) - 1).alias("df"))


def p_value_drift(both: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
    """F15, the preset's branch for small references: per column the p-value of a two-sample
    Kolmogorov-Smirnov test (numeric columns) or a chi-square test (categories, and numeric columns with at
    most FEW_VALUES distinct reference values); drifted below 0.05. Rows of both inputs, told apart by
    `is_ref`. A column without values on one side has no test (NULL, not drifted)."""
    parts = []
    if nums:
        counts = _doubles(both.select(*nums, "is_ref"), nums, "is_ref").groupBy("column_name", "x").agg(
            F.count_if(F.col("is_ref")).alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur"))
        cum = (running_sums(counts, "column_name", "x", ["n_ref", "n_cur"])
               .withColumnRenamed("total_n_ref", "t_ref").withColumnRenamed("total_n_cur", "t_cur"))
        apart = F.abs(F.col("cum_n_ref") / F.nullif("t_ref", F.lit(0)) - F.col("cum_n_cur") / F.nullif("t_cur", F.lit(0)))
        ks = cum.groupBy("column_name").agg(F.max(apart).alias("ks"), F.first("t_ref").alias("t_ref"), F.first("t_cur").alias("t_cur"),
                                            F.count_if(F.col("n_ref") > 0).alias("values"))
        both_tests = ks.join(_chi_square("column_name", cum), "column_name")
        few = F.col("values") <= FEW_VALUES
        some = (F.col("t_ref") > 0) & (F.col("t_cur") > 0)
        parts.append(both_tests.select(
            "column_name", F.lit("numeric").alias("kind"), F.when(few, "chi_square").otherwise("ks").alias("test"),
            F.when(some, F.when(few, F.col("chi_square")).otherwise(F.col("ks"))).alias("statistic"),
            F.when(some, F.when(few, chi_square_p(F.col("chi_square"), F.col("df")))
                   .otherwise(kolmogorov_p(F.col("ks"), F.col("t_ref"), F.col("t_cur")))).alias("drift_score")))
    if cats:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cats])
        j = (both.select(F.inline(pairs), "is_ref").where(F.col("value").isNotNull()).groupBy("column_name", "value")
             .agg(F.count_if(F.col("is_ref")).alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur")))
        tot = j.groupBy("column_name").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
        some = (F.col("t_ref") > 0) & (F.col("t_cur") > 0)
        tested = _chi_square("column_name", j.join(tot.where(some), "column_name"))
        parts.append(tot.join(tested, "column_name", "left").select(
            "column_name", F.lit("categorical").alias("kind"), F.lit("chi_square").alias("test"),
            F.col("chi_square").alias("statistic"), chi_square_p(F.col("chi_square"), F.col("df")).alias("drift_score")))
    rep = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    drifted = F.coalesce(F.col("drift_score") < P_VALUE_THRESHOLD, F.lit(False))
    rep = rep.withColumn("threshold", F.lit(P_VALUE_THRESHOLD)).withColumn("drifted", drifted)
    return _with_share(rep)


def _with_share(rep: DataFrame) -> DataFrame:
    # one row per compared column: a window over the whole (tiny) report
    # avoids evaluating both drift pipelines a second time for the share
    everything = Window.partitionBy()
    share = F.count_if("drifted").over(everything) / F.count(F.lit(1)).over(everything)
    return (rep.withColumn("drift_share", share)
            .withColumn("dataset_drift", F.col("drift_share") >= DATASET_DRIFT_SHARE))


def drift_preset(reference: DataFrame, current: DataFrame) -> DataFrame:
    """the default preset for two inputs. At most SMALL_REFERENCE reference rows are tested by
    p-values (`p_value_drift`), larger references by distances (`drift_report`)."""
    small = reference.limit(SMALL_REFERENCE + 1).count() <= SMALL_REFERENCE
    return _compare(reference, current, p_value_drift if small else drift_of)


def drift_report(reference: DataFrame, current: DataFrame) -> DataFrame:
    """F15 for two inputs by distances: their shared columns."""
    return _compare(reference, current, drift_of)


def _compare(reference: DataFrame, current: DataFrame, test) -> DataFrame:
    shared = [c for c in reference.columns if c in current.columns]
    both = reference.select(*shared, F.lit(True).alias("is_ref")).unionByName(
        current.select(*shared, F.lit(False).alias("is_ref")), allowMissingColumns=False)
    nums = [c for c in numeric_columns(reference) if c in shared and c in numeric_columns(current)]
    return test(both, nums, [c for c in shared if c not in nums])


def drift_of(both: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
    """per column drift score + flag, plus the dataset flag (share of
    drifted columns >= 0.5) on every row. Rows of both inputs, told apart by `is_ref`."""
    parts = []
    if nums:
        parts.append(numeric_drift(both.select(*nums, "is_ref"), nums))
    if cats:
        parts.append(categorical_drift(both.select(*cats, "is_ref"), cats))
    rep = parts[0]
    for p in parts[1:]:
        rep = rep.unionByName(p)
    return _with_share(rep.withColumn("drifted", F.col("drift_score") >= F.col("threshold")))
