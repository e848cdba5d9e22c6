"""Data-quality rules (D2-D7, D14, E9, I1, B5) evaluated in one pass.

A suite is a list of `Rule`s. `annotate` adds `failed_rules: array<string>`
(names of the row-level rules a row violates); `split` turns that into the
passed / rejected pair; `results` gives one row per rule (success, unexpected
count, element count) from one scan: the rows are first combined per value of the
unique column, so copies are counted without a join back. `write_split` takes the counts
per rule and per outcome from the write itself.

Uniqueness is computed as aggregate-then-join, not as a window: the key counts
are a partial/final aggregate (map-side combine), and only keys with more than
one copy are joined back. `write_split` writes these keys first: their size is
then known, so a few are broadcast, small parts of many are hashed, and AQE splits
the partition of a key that holds a third of all rows (it does so only where both
sides of the join are plain shuffles).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpulse.session import session_conf, written_table

NOT_NULL = "not_null"
UNIQUE = "unique"
BETWEEN = "between"
COLUMN_SET = "column_set"


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    mostly: float = 1.0
    columns: tuple[str, ...] = field(default_factory=tuple)

    @property
    def name(self) -> str:
        if self.kind == COLUMN_SET:
            return "table_columns_match_set"
        return f"{self.column}_{self.kind}"


# The two rule suites.
TRANSACTION_COLUMNS = (
    "transaction_id", "transaction_code", "hospital_id", "dept_id", "physician_id", "patient_id",
    "prescription_id", "prescription_detail_id", "bill_id", "procedure_id", "sku_id",
    "transaction_time", "quantity_consumed", "unit_cogs", "unit_price", "margin_amount",
    "margin_percentage", "total_revenue", "transaction_type", "last_updated")
SKU_COLUMNS = (
    "sku_id", "sku_code", "sku_name", "category", "sub_category", "therapeutic_area",
    "brand_generic_flag", "formulary_status", "unit_of_measure", "standard_cost", "shelf_life_days",
    "storage_requirements", "controlled_substance_flag", "halal_certified", "base_drug_name",
    "minimum_order_quantity", "abc_classification", "item_status", "last_updated",
    "current_reorder_level", "ideal_forecasted_reorder_level", "reorder_quantity", "lead_time")

TRANSACTIONS_SUITE = [
    Rule(COLUMN_SET, columns=TRANSACTION_COLUMNS),
    Rule(NOT_NULL, "transaction_id"),
    Rule(NOT_NULL, "transaction_time"),
    Rule(NOT_NULL, "sku_id"),
    Rule(UNIQUE, "transaction_id"),
    Rule(BETWEEN, "quantity_consumed", min_value=0, max_value=None, mostly=1.0),
]
SKU_SUITE = [
    Rule(COLUMN_SET, columns=SKU_COLUMNS),
    Rule(NOT_NULL, "sku_id"),
    Rule(NOT_NULL, "sku_name"),
    Rule(UNIQUE, "sku_id"),
]

# Settings of the split's write: both outcomes are open at once, so the rows need no sort by outcome (Spark
# sorts the rest once as many files are open as allowed, so 2 would sort); keys whose parts are this small are
# hashed in the join instead of both sides being sorted.
SPLIT_CONF = {"spark.sql.maxConcurrentOutputFileWriters": "4",
              "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}

# checkpoints = named (suite, batch) pairs.
CHECKPOINTS = {"transactions_checkpoint": TRANSACTIONS_SUITE, "skus_checkpoint": SKU_SUITE}


def _row_rules(suite):
    return [r for r in suite if r.kind != COLUMN_SET]


def _dup_flag_col(rule: Rule) -> str:
    return f"__dup_{rule.column}"


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that more than one row holds (NULL aside), once each."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
            .where("__n > 1").select(column))


def _with_dup_flags(df: DataFrame, suite, keys=repeated_keys) -> DataFrame:
    rows = df
    for r in suite:
        if r.kind != UNIQUE:
            continue
        dups = keys(rows, r.column).select(r.column, F.lit(True).alias(_dup_flag_col(r)))
        df = df.join(dups, r.column, "left")
    return df


def _violation(r: Rule, df_cols) -> F.Column:
    """True when the row violates `r`. Nulls pass range rules (as in the
    rule library's semantics); missing columns make the rule fail on every row."""
    if r.column not in df_cols:
        return F.lit(True)
    c = F.col(r.column)
    if r.kind == NOT_NULL:
        return c.isNull()
    if r.kind == UNIQUE:
        return F.coalesce(F.col(_dup_flag_col(r)), F.lit(False))
    if r.kind == BETWEEN:
        cond = F.lit(False)
        if r.min_value is not None:
            cond = cond | (c < F.lit(r.min_value))
        if r.max_value is not None:
            cond = cond | (c > F.lit(r.max_value))
        return c.isNotNull() & (cond | F.isnan(c))
    raise ValueError(r.kind)


def annotate(df: DataFrame, suite, keys=repeated_keys) -> DataFrame:
    """Add `failed_rules` (array of violated row-rule names, may be empty)."""
    cols = list(df.columns)
    flagged = _with_dup_flags(df, [r for r in suite if r.kind == UNIQUE and r.column in cols], keys)
    none = F.array().cast("array<string>")
    # one short array per rule, joined: generated code, where a filter by lambda is interpreted row by row
    out = flagged.withColumn("failed_rules", F.concat(none, *[
        F.when(_violation(r, cols), F.array(F.lit(r.name))).otherwise(none) for r in _row_rules(suite)]))
    return out.drop(*[c for c in out.columns if c.startswith("__dup_")])


def split(df: DataFrame, suite) -> tuple[DataFrame, DataFrame]:
    """(passed rows, rejected rows with `failed_rules`)."""
    ann = annotate(df, suite)
    passed = ann.where(F.size("failed_rules") == 0).drop("failed_rules")
    rejected = ann.where(F.size("failed_rules") > 0)
    return passed, rejected


def write_split(df: DataFrame, suite, path: str) -> dict[str, int]:
    """D6 / B3 / B5 written once: the annotated rows go to `path`, a folder for
    each outcome, from one evaluation of the rules. `read_split` reads them. Returns the counts
    that the write saw: rows, passed, rejected and one per rule."""
    from stockpulse.sources.zones import counted
    names = [r.name for r in _row_rules(suite)]
    marked = (annotate(df, suite, lambda rows, column: written_table(repeated_keys(rows, column), "repeated"))
              .withColumn("passed", F.size("failed_rules") == 0))
    with session_conf(df.sparkSession, SPLIT_CONF):
        got = counted(marked, lambda x: x.write.mode("overwrite").partitionBy("passed").parquet(path),
                      passed=F.count_if("passed"), rejected=F.count_if(~F.col("passed")),
                      **{f"__r{i}": F.count_if(F.array_contains("failed_rules", n)) for i, n in enumerate(names)})
    return {k: got[k] for k in ("rows", "passed", "rejected")} | {f"rule:{n}": got[f"__r{i}"] for i, n in enumerate(names)}


def read_split(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(passed rows, rejected rows with `failed_rules`) of `write_split`."""
    both = spark.read.parquet(path)
    if "passed" not in both.columns:               # an empty input wrote no folder
        both = both.withColumn("passed", F.lit(True))
    ok = F.col("passed").cast("boolean")
    return both.where(ok).drop("failed_rules", "passed"), both.where(~ok).drop("passed")


def column_set_result(df: DataFrame, rule: Rule) -> dict:
    """Dataset-level column-set check; lists no rows."""
    have, want = set(df.columns), set(rule.columns)
    return {"rule": rule.name, "success": have == want,
            "missing": sorted(want - have), "unexpected": sorted(have - want)}


def results(df: DataFrame, suite) -> DataFrame:
    """One row per rule: rule, column, element_count,
    unexpected_count, unexpected_percent, success (with `mostly`). The
    column-set rule is dataset-level: its element count is the expected
    column count and its unexpected count the missing + extra columns."""
    cols = list(df.columns)
    rows = _row_rules(suite)
    unique = [r for r in rows if r.kind == UNIQUE and r.column in cols]
    lead = unique[0].column if unique else None
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, r in enumerate(rows):
        if r not in unique:
            aggs.append(F.count_if(_violation(r, cols)).alias(f"__v{i}"))
        aggs.append((F.count(r.column) if r.column in cols else F.lit(0)).alias(f"__nn{i}"))
    # one row per value of the unique column, then one row
    per = df.groupBy(F.col(lead).alias("__key")).agg(*aggs) if lead else df.agg(*aggs).withColumn("__key", F.lit(None))
    copies = F.coalesce(F.sum(F.when(F.col("__key").isNotNull() & (F.col("__n") > 1), F.col("__n"))), F.lit(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    agg = per.agg(zero("__n").alias("__rows"), *[zero(f"__nn{i}").alias(f"__nn{i}") for i in range(len(rows))],
                  *[(copies if r in unique else zero(f"__v{i}")).alias(f"__v{i}") for i, r in enumerate(rows)
                    if r not in unique[1:]])
    for r in unique[1:]:                 # further unique columns: a count over their own values each
        i = rows.index(r)
        mine = (df.where(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .agg(zero("n").alias(f"__v{i}"), F.lit(1).alias("__one")))
        agg = agg.withColumn("__one", F.lit(1)).join(mine, "__one").drop("__one")      # one row each
    stack = ", ".join(f"'{r.name}', '{r.column}', {r.mostly}D, "
                      f"{'__rows' if r.kind in (NOT_NULL,) else f'__nn{i}'}, __v{i}"
                      for i, r in enumerate(rows))
    out = agg.selectExpr(f"stack({len(rows)}, {stack}) AS (rule, column_name, mostly, element_count, unexpected_count)")
    for r in suite:                      # D2: dataset-level column-set rule, one row
        if r.kind == COLUMN_SET:
            cs = column_set_result(df, r)
            bad = len(cs["missing"]) + len(cs["unexpected"])
            # schema-only result: a one-row literal frame, no second pass over the data
            row = df.sparkSession.range(1).selectExpr(f"'{r.name}' AS rule", "CAST(NULL AS STRING) AS column_name",
                                 f"{1.0 if cs['success'] else 0.0}D AS mostly",
                                 f"CAST({len(r.columns)} AS BIGINT) AS element_count",
                                 f"CAST({bad} AS BIGINT) AS unexpected_count")
            out = out.unionByName(row)
    pct = F.when(F.col("element_count") > 0,
                 F.col("unexpected_count").cast("double") * 100.0 / F.col("element_count")).otherwise(0.0)
    return out.select(
        "rule", "column_name", F.col("element_count").cast("bigint").alias("element_count"),
        F.col("unexpected_count").cast("bigint").alias("unexpected_count"),
        pct.alias("unexpected_percent"),
        F.when(F.col("rule") == "table_columns_match_set", F.col("unexpected_count") == 0)
         .otherwise(pct <= (1.0 - F.col("mostly")) * 100.0 + 1e-12).alias("success"),
    )


def run_checkpoint(df: DataFrame, name: str):
    """Run a named checkpoint -> (passed, rejected, per-rule results,
    column-set result)."""
    suite = CHECKPOINTS[name]
    passed, rejected = split(df, suite)
    cs = [column_set_result(df, r) for r in suite if r.kind == COLUMN_SET]
    return passed, rejected, results(df, suite), cs
