"""The corpus pipeline against the plain versions, stage by stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as cp
from conftest import SF_SMALL
from test_documents import corpus


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the smallest documents plus odd rows."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("spans", F.lit("x"))
    odd = [(100_000 + i, t, None, "s", None if t is None else len(t), "y") for i, (_, t) in enumerate(corpus(9, 30)[:60])]
    odd += [odd[0], (200_000, "123 456", "en", None, 7, None)]
    docs = docs.unionByName(spark.createDataFrame(
        odd, "doc_id long, text string, lang string, source string, n_chars long, spans string"))
    seen = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF_SMALL), f"test-{name}")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans"]
        seen.append(docs.collect())
    return seen


def test_language_stage_drops_only_rejects(stages):
    gone = Counter(r["doc_id"] for r in stages[0]) - Counter(r["doc_id"] for r in stages[1])
    letterless = Counter(r["doc_id"] for r in stages[0] if not any(c.isalpha() for c in r["text"] or ""))
    assert gone == letterless


def test_near_dedup_stage_keeps_one_of_a_class(stages):
    comp = brute.op5([(r["doc_id"], r["text"]) for r in stages[1]])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted({c for _, _, c in comp})


def test_substring_stage(stages):
    want = {d: (n, k) for d, _, n, k in brute.op2([(r["doc_id"], r["text"]) for r in stages[2]])}
    assert len(stages[3]) == len(stages[2])
    before = {r["doc_id"]: r for r in stages[2]}
    for r in stages[3]:
        n, sha = want[r["doc_id"]]
        if n:
            assert brute.sha(r["text"].encode()) == sha and r["n_chars"] == len(r["text"])
        else:
            assert r == before[r["doc_id"]]


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.op9([(r["doc_id"], r["text"]) for r in stages[3]], items) if not r[5]}
    assert {r["doc_id"] for r in stages[4]} == clean


def test_mixing_stage(stages):
    sizes = Counter()
    for r in stages[4]:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    taken = Counter()
    for r in stages[5]:
        assert r["taken"] == r["size"] * r["copies"] > 0 and r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())


def test_run_is_the_stages(spark):
    out = cp.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF_SMALL), "test-run")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF_SMALL).count() == 0
