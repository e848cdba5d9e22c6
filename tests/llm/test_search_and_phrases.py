"""Exact top-k search, collocations and ranked search against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import collocations, mtree, queries, reversed_search
from tests.llm import brute

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                    T.StructField("rank", T.StringType()), T.StructField("V", T.StringType())])
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()),
                    T.StructField("KEY", T.StringType())])
ITEM = "item_id long, text string, n string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n=700, dim=8):
    rnd = random.Random(5)
    out = [(i, [rnd.gauss(0, 1) * 0.3 for _ in range(dim)]) for i in range(n)]
    out += [(n + i, [0.25] * dim) for i in range(200)]                       # a third are copies
    out += [(2 * n + i, [0.25 + i * 1e-4] * dim) for i in range(100)]        # near copies
    return out + [(20, [0.5] * dim), (40, out[40][1]), (None, [0.25] * dim), (None, [9.0] * dim),
                  (5000, None), (5020, []), (5040, [float("nan")] * dim), (5060, [None] * dim), (5080, [float("inf")] * dim),
                  (5100, [0.5, 1.0]), (5120, [0.25, 2.0]), (5140, [3.0]), (-60, [1.0] * dim), (5160, [0.0] * dim)]


@pytest.mark.parametrize("shard_values", [1 << 21, 512])
def test_top_k_equals_brute_force(spark, shard_values):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VEC).repartition(5)
    got = mtree.search(df, F.col("id") % 20 == 0, shard_values=shard_values)
    assert rows_of(got) == sorted(brute.op11(rows), key=repr)


def test_top_k_of_few_rows_and_none(spark):
    one = spark.createDataFrame([(20, [1.0, 2.0], "", "")], VEC)
    assert mtree.search(one, F.col("id") % 20 == 0).count() == 0
    assert mtree.search(one.limit(0), F.col("id") % 20 == 0).count() == 0
    two = one.unionByName(spark.createDataFrame([(3, [1e300, -1e300], "", "")], VEC))
    assert rows_of(mtree.search(two, F.col("id") % 20 == 0)) == [(20, 1, 3, -9223372036854775808)]


def test_tree_skips_distances_and_stays_exact():
    rnd = np.random.default_rng(3)
    middle = rnd.normal(0, 60, (40, 16))
    rows = np.floor(middle[rnd.integers(0, 40, 6000)] + rnd.normal(0, 3, (6000, 16))).astype(np.int64)
    top = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max()))
    tree = mtree.MTree(rows, top)
    q = rows[:64]
    best = mtree.Best(len(q), 10, np.arange(len(rows)), np.zeros(len(rows), bool), np.zeros(len(q), np.int64), np.zeros(len(q), bool))
    tree.search(q, best)
    assert (best.score == -np.sort(-(q @ rows.T), axis=1)[:, :10]).all()
    assert tree.computed < 0.2 * len(q) * len(rows) and tree.skipped > 0      # pages that are never opened count as neither


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[1 << 40, 3]]), np.array([[(1 << 20) + 1, 1], [1 << 40, 1 << 40]])
    assert mtree.products(a, b).tolist() == [[(1 << 60) + (1 << 40) + 3, 9223372036854775807]]


def corpus():
    rnd = random.Random(9)
    words = ["Ra", "ro", "ri", "Ré", "ru", "ra", "ry", "rä"] + [f"w{i}" for i in range(60)]
    weights = [30, 20, 20, 10, 9, 5, 5, 4] + [1] * 60
    out = []
    for i in range(400):
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";x!"])
                       for w in rnd.choices(words, weights, k=rnd.randint(0, 40)))
        out.append((i, text, rnd.choice(["en", "en", "en", "de", None, "a\tb"])))
    out += [(1000 + i, "one two three four. one two three", "en") for i in range(12)]
    return out + [(2000, None, "en"), (2001, "", "en"), (2002, " .,; ", "xx"), (2003, "ra ro " * 30000, "en"), (None, "ra ro", "en")]


@pytest.mark.parametrize("rate", [0.25, 0.02, 1.0])
def test_collocations_equal_brute_force(spark, rate):
    rows = corpus()
    df = spark.createDataFrame([(i, t, x, "", "") for i, t, x in rows], DOC).repartition(4)
    got = collocations.mine(df, sample_rate=rate)
    assert rows_of(got) == sorted(brute.op12([(x, t) for _, t, x in rows]), key=repr)


def test_border_failures_are_expanded(spark):
    """Nothing of the corpus is in the sample: the first pass counts words only, the next ones close the border."""
    rows = [(i, "alpha beta gamma delta", "en") for i in range(40)]
    df = spark.createDataFrame([(i, t, x, "", "") for i, t, x in rows], DOC)
    known, passes = collocations.frequent_phrases(df, sample_rate=0.0)
    assert passes == 3
    assert {r["phrase"]: r["f"] for r in known.filter("m = 3").collect()} == {"alpha beta gamma": 40, "beta gamma delta": 40}
    everything, one = collocations.frequent_phrases(df, sample_rate=1.0)
    assert one == 1 and rows_of(everything) == rows_of(known)


def test_filters_full_of_strangers_lose_no_phrase(spark):
    """Pairs whose first word is not in the sample are taken for proposed ones by a small filter; the
    phrases around them must be counted all the same when that word is added."""
    rnd = random.Random(0)
    texts = [f"u{g} c{g % 20} d{g % 25}. " * 12 for g in range(800)]
    texts += [" ".join(f"c{rnd.randrange(20)} d{rnd.randrange(25)}" for _ in range(40)) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "en", "", "") for i, t in enumerate(texts)], DOC)
    want = {}
    for words in (piece.split() for t in texts for piece in t.split(".")):
        for m in (1, 2, 3):
            for i in range(len(words) - m + 1):
                p = " ".join(words[i:i + m])
                want[p] = want.get(p, 0) + 1
    known, _ = collocations.frequent_phrases(df, filter_bits=(1 << 12, 1 << 12))
    assert rows_of(known.filter("m > 0").select("phrase", "f")) == sorted(((p, f) for p, f in want.items() if f >= 10), key=repr)


def test_long_texts_are_cut_without_losing_phrases(spark, monkeypatch):
    text = " ".join(f"a{i % 7}" for i in range(3000)) + "." + "z" * 5000 + " a1 a2"
    monkeypatch.setattr(collocations.bs, "SLICE_BYTES", 256)
    monkeypatch.setattr(collocations.tokens, "SLICE", 256)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    none = collocations.Bloom(np.zeros(1 << 14, np.uint64))
    every = collocations.Bloom(np.full(1 << 14, 0xFFFFFFFFFFFFFFFF, np.uint64))

    class Shared:
        value = ([[none], [none]], [every, every])
    found = {}
    for out in collocations._expand(3, Shared)(iter([batch])):
        for key, f in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            found[key.split("\t")[1]] = found.get(key.split("\t")[1], 0) + f
    words = text.split(".")
    want = {}
    for piece in words:
        w = piece.split()
        for m in (2, 3):
            for i in range(len(w) - m + 1):
                p = " ".join(w[i:i + m])
                want[p] = want.get(p, 0) + 1
    assert found == want


def test_scores_may_pass_64_bits(spark):
    known = spark.createDataFrame([("en", 1, "x", 10**13), ("en", 1, "y", 10**13), ("en", 2, "x y", 9 * 10**12)],
                                  "lang string, m int, phrase string, f long")
    assert [r["score"] for r in collocations.scored(known).collect()] == [810000]


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], DOC)
    assert collocations.mine(df).count() == 0


def found_docs():
    rnd = random.Random(2)
    words = [f"T{i}" for i in range(50)] + ["été", "ÉTÉ", "x-y", "a_b"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(200)]
    docs += [(300 + i, "t1 t2 t3 t4") for i in range(60)]
    return docs + [(400, None), (401, ""), (402, "?!"), (None, "t1 t2 t3 t4"), (10, "t1 t2"), (10, "t1 t2"), (403, "t7 " * 400000)]


def test_ranked_search_equals_brute_force(spark):
    docs = found_docs()
    items = [(1, "T1, t2! t3"), (2, "été ÉTÉ x y"), (3, ""), (4, None), (5, "nowhere"), (6, "t7"), (1, "T1, t2! t3"), (None, "t9 b")]
    d = spark.createDataFrame([(i, t, "", "", "") for i, t in docs], DOC).repartition(4)
    b = spark.createDataFrame([(i, t, "") for i, t in items], ITEM)
    want = sorted(brute.op13(docs, items), key=repr)
    assert rows_of(reversed_search.search(d, b)) == want
    assert rows_of(reversed_search.search(d, b, block_bytes=40)) == want     # several blocks of items
    assert reversed_search.search(d.limit(0), b).count() == 0
    assert reversed_search.search(d, b.limit(0)).count() == 0


def test_registered_queries_equal_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    vecs = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(queries.op11_exact_top_k(spark, sf)) == sorted(brute.op11(vecs), key=repr)
    assert rows_of(queries.op12_collocations(spark, sf)) == sorted(brute.op12([(x, t) for _, t, x in docs]), key=repr)
    assert rows_of(queries.op13_ranked_search(spark, sf)) == sorted(brute.op13([(i, t) for i, t, _ in docs], items), key=repr)
