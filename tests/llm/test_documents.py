"""Text operators against the plain versions in brute.py, with hot groups, nulls,
empty and long texts, repeated rows, clashing columns and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from stockpulse.llm import decontam, simhash, substr_dedup, suffix_dedup
from stockpulse.session import ship_package

WORDS = [f"w{i}" for i in range(6)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def corpus(seed, n=60, length=120):
    """Shared passages, copies, near copies, constant runs, nulls, blanks, a long text."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice([f"a{rng.randrange(300)}", *WORDS]) for _ in range(rng.randrange(length)))
        if rng.random() < 0.6:
            t += "  \n" + rng.choice(base) + "\t" + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(20)))
        if rng.random() < 0.1:
            t = "x " * rng.randrange(120)
        rows.append((i if rng.random() > 0.05 else None, t if rng.random() > 0.03 else None))
    rows += rows[:5]                                             # repeated rows
    rows += [(500 + i, base[0] + f" tail{i}") for i in range(n // 3)]   # a hot passage
    rows += [(600, ""), (601, None), (602, " \t\n"), (603, "Größe naïve 日本語 " * 30)]
    rows += [(604, " ".join(rng.choice(WORDS) + str(rng.randrange(9999)) for _ in range(20_000)))]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("bucket", [50_000, 30])
def test_substring_dedup(spark, bucket):
    rows = corpus(1)
    out = substr_dedup.remove_repeated_words(frame(spark, rows), bucket_windows=bucket).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], substr_dedup.sha256_hex(r["kept_text"])) for r in out)
    assert got == Counter(brute.op2(rows))


@pytest.mark.parametrize("bucket", [200_000, 100])
def test_suffix_dedup(spark, bucket):
    rows = [r for r in corpus(2, 40) if r[0] != 604]
    out = suffix_dedup.remove_repeated_bytes(frame(spark, rows), bucket_windows=bucket).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], suffix_dedup.sha256_hex(bytes(r["kept_bytes"])))
                  for r in out)
    assert got == Counter(brute.op7(rows))


def test_corpus_order_is_suffix_order():
    import numpy as np
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(400))) for _ in range(12)] + [b"ab" * 300] * 2 + [b""]
    begin = np.append(0, np.cumsum([len(p) for p in parts]))
    data = np.frombuffer(b"".join(parts), np.uint8)
    order = suffix_dedup.corpus_order(data, begin)
    ends = np.repeat(begin[1:], np.diff(begin))
    suffixes = [data[i:ends[i]].tobytes() for i in order]
    assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(len(data)))


def test_simhash_classes(spark):
    rows = corpus(4)
    out = simhash.near_duplicate_classes(frame(spark, rows)).collect()
    got = Counter((r["id"], f"{r['fp'] & (2**64 - 1):016x}", r["component"]) for r in out)
    assert got == Counter(brute.op5(rows))


@pytest.mark.parametrize("size", [1024, 8])
def test_simhash_links_with_hot_shards(spark, size):
    """Fingerprints around few centres: shards over the tree size are dealt anew and split."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centres for _ in range(60)}
    fps |= {0, (1 << 64) - 1, 7}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), tree_size=size).collect()
    assert all(((e["u"] ^ e["v"]) & (2**64 - 1)).bit_count() <= 64 for e in edges)
    near = [(i, j) for i in range(len(signed)) for j in range(i)
            if ((signed[i] ^ signed[j]) & (2**64 - 1)).bit_count() <= 3]
    at = {f: i for i, f in enumerate(signed)}
    want = brute.classes(len(signed), near)
    got = brute.classes(len(signed), [(at[e["u"]], at[e["v"]]) for e in edges])
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
    assert len(edges) < len(signed) * 30                        # a forest per task, not all pairs


def test_bk_tree_matches_a_scan():
    rng = random.Random(6)
    vals = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree(vals)
    for q in (rng.getrandbits(16) for _ in range(50)):
        assert sorted(tree.within(q, 3)) == sorted({v for v in vals if (v ^ q).bit_count() <= 3})


def test_one_document_of_each_class_stays(spark):
    rows = corpus(7)
    docs = frame(spark, rows).withColumn("fp", F.lit("x")).withColumn("c", F.lit(1)).withColumn("least", F.lit(2))
    out = simhash.keep_one_per_class(docs)
    assert out.columns == docs.columns
    comp = [c for _, _, c in brute.op5(rows)]
    kept = Counter(r["doc_id"] for r in out.collect())
    roots = {}
    for (d, t), (_, fp, c) in zip(rows, brute.op5(rows)):
        roots.setdefault(c if c is not None else ("null", fp), d)
    assert out.count() == len(set(roots)) and {k for k in kept if k is not None} <= set(comp)


def benchmark(seed):
    rng = random.Random(seed)
    base = corpus(8)
    items = [(i, " ".join((base[i][1] or "zz").split()[:rng.randrange(5, 40)])) for i in range(12)]
    return items + [(3, "W1 w2, W3"), (None, "w4 w5 w0 w4 w4"), (20, ""), (21, None), (22, "?!"), (23, items[0][1]), (0, items[1][1])]


@pytest.mark.parametrize("shard, block", [(1 << 18, 8 << 20), (50, 400)])
def test_decontamination(spark, shard, block):
    rows, items = corpus(8), benchmark(1)
    out = decontam.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"),
                                      keep=["doc_id"], shard_words=shard, block_bytes=block).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"]).encode()),
                   r["contaminated"]) for r in out)
    want = Counter(brute.op9(rows, items))
    assert got == want and any(x[5] for x in want) and any(not x[5] for x in want)


def test_fm_index_counts_and_locates():
    import numpy as np
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 4, 500)
    index = decontam.FMIndex(seq, 4)
    for n in (1, 2, 5):
        table = rng.integers(1, 4, (40, n))
        lo, hi = index.search(table, np.full(40, n))
        for p, a, b in zip(table, lo, hi):
            want = [i for i in range(len(seq) - n + 1) if (seq[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_words string, spans string, row_key int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substr_dedup.remove_repeated_words(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert simhash.near_duplicate_classes(none).count() == 0
    assert simhash.keep_one_per_class(none).count() == 0
    assert decontam.find_contamination(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b", "n", "s", 5)], none.schema)
    r = substr_dedup.remove_repeated_words(one).first()
    assert (r["n_words"], r["n_words_"], r["row_key"], r["kept_text"]) == ("n", 2, 5, "a b")
    r = decontam.find_contamination(one, bench).first()
    assert (r["n_words"], r["spans"], r["n_words_"], r["contaminated"]) == ("n", "s", 2, False)
