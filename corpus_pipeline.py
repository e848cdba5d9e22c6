"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every
result as Parquet in the shared folder and reads it back as the next stage's input.

1. language_id: learns on the incoming rows that have a language (the folds of
   the language query) and drops rows whose text is null or has no letter.
2. near_dedup: keeps one document of each class of SimHash near copies (the shingle
   length and bit distance of the SimHash query): the smallest id.
3. substring_dedup: removes words in repeated windows; text and n_chars change,
   no row goes.
4. decontamination: drops documents that the benchmark contaminates.
5. mixing: the mix: documents taken at least once, with how often and how many words.

All stages but the last return the columns of `documents`. Nulls, empty texts,
repeated rows, empty tables and extra columns are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockpulse.llm import decontam, langid, mixing, simhash, substr_dedup
from stockpulse.llm.sampling import fold
from stockpulse.llm.scratch import unused, written
from stockpulse.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = langid.train(docs, fold("doc_id", 4) != 2)
    pred = unused("lang_pred", docs.columns)
    judged = langid.predict(docs, model)
    return judged.filter(F.col(pred) != langid.UND).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one_per_class(docs, shingle=simhash.SHINGLE_WORDS, radius=simhash.RADIUS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept words joined by one space; a document that loses none keeps its text as it is."""
    ship_package(spark)
    names = []
    for c in ("n_words", "n_removed", "kept_text"):
        names.append(unused(c, docs.columns + names))
    out = substr_dedup.remove_repeated_words(docs)
    new = {"text": F.when(F.col(names[1]) > 0, F.col(names[2])).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(names[1]) > 0, F.length(names[2]).cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    out = decontam.find_contamination(docs, bench)
    return out.filter(~F.col(unused("contaminated", docs.columns))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = mixing.mix(docs)
    return out.filter(F.col(unused("copies", docs.columns)) * F.col(unused("size", docs.columns)) > 0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("mixing", mix_sources)]
ORACLE_SQL = None      # language ID and classes of near copies are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
