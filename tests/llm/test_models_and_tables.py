"""Embeddings, URL rules, mixing and the classifiers."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF_SMALL
from stockpulse.llm import embed_dedup, langid, mixing, quality, queries, toxicity, url_filter
from stockpulse.llm.sampling import bounded_ids, fold
from stockpulse.session import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# ------------------------------------------------------------------ embeddings

def vectors(seed, groups, lone, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        c = rng.normal(size=dim)
        rows += [(c + 0.25 * rng.normal(size=dim) * np.linalg.norm(c) / 4).tolist() for _ in range(size)]
    rows += rng.normal(size=(lone, dim)).tolist()
    rows += rows[:7] + [[2 * x for x in rows[0]]]
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] + [1.0] * (dim - 1),
             [1e300] * dim, [1e-300] * dim, [1.0, 0.0], [1.0, 0.1]]
    return [(i if i % 17 else None, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("shard", [2048, 24])
def test_embedding_links(spark, shard):
    """24: shards over their size are split and searched part by part."""
    rows = vectors(1, [40, 9, 2, 2], 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = embed_dedup.near_duplicate_vectors(df, shard_size=shard).collect()
    # extreme lengths overflow the plain version: both 1e300 and 1e-300 point one way
    plain = [(i, [x / 1e300 for x in v] if v and v[0] == 1e300 else [x * 1e300 for x in v] if v and v[0] == 1e-300 else v)
             for i, v in rows]
    want = brute.op1(plain)
    got = Counter((r["id"], r["n_links"], r["component"]) for r in out)
    assert got == Counter(w[:3] for w in want)
    assert all(r["recall"] is None or r["recall"] >= 0.9 for r in out)


def test_large_shards_are_split_and_dense_groups_stay_whole(spark):
    """Four centres for 900 vectors, shards of 32: two further levels of centres."""
    rows = [(i, v) for i, (_, v) in enumerate(vectors(5, [220, 30, 9] + [3] * 40, 500)) if v and len(v) == 16 and i < 880]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = embed_dedup.near_duplicate_vectors(df, shard_size=32, max_centres=4).collect()
    want = {i: n for i, n, *_ in brute.op1(rows)}
    assert sum(want.values()) > 40_000
    got = {r["id"]: r["n_links"] for r in out}
    assert all(got[i] <= n for i, n in want.items())
    shares = [got[i] / n for i, n in want.items() if n]
    assert sum(shares) / len(shares) >= 0.9
    assert {r["recall"] for r in out} != {None}


def test_centres_of_one_dense_group_are_one_shard():
    rng = np.random.default_rng(3)
    c = embed_dedup.unit(np.vstack([np.ones(8) + 0.05 * rng.normal(size=(5, 8)), np.eye(8)[:3]]))
    centres, starts = embed_dedup.shards_of(c, 0.9)
    assert starts.tolist() == [0, 5, 6, 7] and len(centres) == 8
    near = embed_dedup.nearest_shards(embed_dedup.unit(np.vstack([np.ones((1, 8)), np.eye(8)[1:2]])), centres, starts, 1)
    assert near.tolist() == [[0], [2]]


def test_recall_under_the_demanded_one_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(20)], "vec_id long, embedding array<double>")
    lost = embed_dedup._search_once

    def half(*args):
        members, found = lost(*args)
        return members, found.filter("u % 2 = 0")
    monkeypatch.setattr(embed_dedup, "_search_once", half)
    with pytest.raises(embed_dedup.RecallError):
        embed_dedup.near_duplicate_vectors(df)


def test_embedding_tables_without_links(spark):
    schema = "vec_id long, embedding array<float>"
    assert embed_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    r = embed_dedup.near_duplicate_vectors(spark.createDataFrame([(4, [1.0, 2.0])], schema)).first()
    assert (r["id"], r["n_links"], r["component"]) == (4, 0, 4)


def test_range_search_finds_a_dense_group():
    rng = np.random.default_rng(2)
    v = embed_dedup.unit(np.vstack([rng.normal(size=(300, 24)), rng.normal(size=24) * 3 + 0.2 * rng.normal(size=(300, 24))]))
    adj = embed_dedup.prune(v @ v.T, embed_dedup.medoid_of(v), np.random.default_rng(0))
    for own in (np.arange(600), np.full(600, -1)):
        qi, xi = embed_dedup.range_search(v, adj, embed_dedup.medoid_of(v), v, own, 0.9, 32)
        truth = (v @ v.T >= 0.9).sum()
        assert len(set(zip(qi.tolist(), xi.tolist()))) == len(qi) >= 0.95 * truth


# ------------------------------------------------------------------ URL rules

def test_url_rules(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/2?q#f", "http://wwwexample.com/en/",
            "http://m.example.com/en", "http://x.net/es/", "http://net/fr/a", "http://y.net/fr", "ftp://user@com/",
            "no-scheme.com/", "://com/", "http://", None, "", "http://Ünet/es/?x", "http://cheap-pills.example.org/en/",
            "http://a.b-cheap-pills.org/x", "http://spam-farm.net/es", "http://spam.farm.net/x", "http://farm-spam.net/x",
            "http://not-spam-farms.net/", "http://x.com?y=/en/", "http://x.com#://net/es/", "http://a.example.com/en/\n/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("mine"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])
                  for r in url_filter.filter_urls(df, keep=["page_id"]).collect())
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    want = Counter()
    for p, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
               and path.startswith(r[r.index("/"):])]
        best = max(fit, key=len) if fit else None
        bad = any(("." + host).replace("-", ".-").find(f"{cut}{name}.") >= 0 for cut in (".", ".-")
                  for name in ("cheap.-pills", "spam.-farm"))
        want[(p, host, path, best, rules[best] if best else "block" if bad else "allow")] += 1
    assert got == want
    assert url_filter.filter_urls(df).columns == ["page_id", "url", "rule", "host", "path", "rule_", "verdict"]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_no_given_rule_is_fetched_by_every_url():
    assert all(url_filter.ANY not in r.tokens() for r in url_filter.RULES + url_filter.DEFAULT_PATTERNS)
    assert url_filter.Rule("block", "my-shop.example.com", "/a/b").tokens() == ["my", "shop", "example", "com", "/a"]


def test_a_rule_without_a_path_fits_whole_hosts(spark):
    urls = ["http://example.com", "http://a.example.com/x", "http://example.community/", "http://myexample.com/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["verdict"] for r in url_filter.filter_urls(df, rules=[url_filter.Rule("block", "example.com", "")]).collect()}
    assert [got[u] for u in urls] == ["block", "block", "allow", "allow"]


def test_many_rules_run_only_behind_their_rarest_token(spark):
    rng = random.Random(1)
    names = [f"n{i}" for i in range(40)]
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), f"{rng.choice(names)}.org", f"/{rng.choice(names)}/")
             for _ in range(200)]
    rules = list({r.name: r for r in rules}.values())
    urls = [f"http://{rng.choice(names)}.{rng.choice(names)}.org/{rng.choice(names)}/{i}" for i in range(300)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["rule"] for r in url_filter.filter_urls(df, rules=rules).collect()}
    for u in urls:
        host, path = u[7:].split("/", 1)
        fit = [r.name for r in rules if host.endswith("." + r.host) and ("/" + path).startswith(r.path)]
        assert got[u] == (fit[0] if fit else None)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF_SMALL).toPandas()[want.columns]

    def key(df):
        return Counter(tuple(None if v is None or v != v else v for v in r) for r in df.itertuples(index=False))

    assert key(got) == key(want)


# ------------------------------------------------------------------ mixing

def plain_mix(rows):
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, live = {}, 1.5 * sum(sizes.values()), set(order)
    while live:
        share = left / sum(weight[s] for s in live)
        over = [s for s in live if weight[s] * share > 2 * sizes[s]]
        for s in over or live:
            target[s] = 2 * sizes[s] if over else weight[s] * share
        left -= sum(target[s] for s in over)
        live = live - set(over) if over else set()
    return sizes, target


def test_mixing_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "é", None, "Z", "z", "hot", "hot", "hot"]), rng.randrange(0, 60)) for i in range(900)]
    rows += [(None, "a", 7)] * 3 + [(5000, "tiny", 2), (5001, "none", 0)]
    df = spark.createDataFrame([(i, s, " ".join(["w"] * n) if n else None) for i, s, n in rows],
                               "doc_id long, source string, text string").withColumn("size", F.lit("x")).repartition(5)
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "source", "text", "size", "size_", "source_size", "target", "copies", "taken"]
    got = out.collect()
    sizes, target = plain_mix(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size_"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 30
    again = mixing.mix(df.repartition(2)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_a_source_of_null_ids(spark):
    """All rows share one order hash: the cut falls inside one bucket."""
    rng = random.Random(4)
    rows = [(None, None, rng.randrange(1, 40)) for _ in range(1200)] + [(7, "b", rng.randrange(1, 40)) for _ in range(900)]
    df = spark.createDataFrame([(i, s, " ".join(f"w{k}" for _ in range(n)), {"k": k}) for k, (i, s, n) in enumerate(rows)],
                               "doc_id long, source string, text string, extra map<string,int>").repartition(5)
    sizes, target = plain_mix(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted((r["text"], r["copies"]) for r in got) == sorted((r["text"], r["copies"]) for r in again)
    for s in sizes:
        mine = [(r["size"], r["copies"]) for r in got if r["source"] == s]
        assert abs(sum(n * c for n, c in mine) - target[s]) <= 20
        # of one hash the smaller documents are asked first
        more = [n for n, c in mine if c == max(c for _, c in mine)]
        rest = [n for n, c in mine if c < max(c for _, c in mine)]
        assert not rest or max(more) <= min(rest)


# ------------------------------------------------------------------ classifiers

def test_folds(spark):
    df = spark.createDataFrame([(7,), (12345,), (None,)], "doc_id long")
    assert [r[0] for r in df.select(fold("doc_id", 5)).collect()] == [brute.fold(7, 5), brute.fold(12345, 5), 0]


def word_list(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_toxicity(spark):
    rng = random.Random(5)
    ordinary, insults = word_list(rng, "abcdefgh", 400), ["grobl", "snarf", "vexx"]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(ordinary) for _ in range(rng.randrange(5, 120))]
        y = int(rng.random() < 0.3)
        for _ in range(1 + len(w) // 25 if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(insults).upper())
        docs.append((i, " ".join(w)))
        if rng.random() < 0.9:
            labels.append((i, y))
    truth = dict(labels)
    labels += [(1, truth.get(1)), (None, 1), (2, None)]
    docs += [(5000, ""), (5001, None), (5002, "?? !!"), (None, "grobl snarf"), docs[3]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i in truth if brute.fold(i, 5) == 0]
    assert brute.auc([got[i] for i in held], [truth[i] for i in held]) > 0.97
    assert sum((got[i] >= 0.5) == bool(truth[i]) for i in held) > 0.93 * len(held)
    assert got[5000] == got[5001] == got[5002] and all(0 <= s <= 1 for s in got.values()) and got[None] > 0.5
    # no labels, one class, no rows
    empty = toxicity.train(d, lab.limit(0))
    assert {r["score"] for r in toxicity.score(d, empty).collect()} <= {r["score"] for r in toxicity.score(d.limit(1), empty).collect()}
    assert toxicity.score(d, toxicity.train(d, lab.filter("toxic = 1"))).filter("score < 0.9").count() == 0
    assert toxicity.score(d.limit(0), model).count() == 0


def test_toxicity_counts_all_labelled_documents(spark):
    """A word of toxic documents that a sample of 4,096 per class would leave out."""
    rows = [(i, i % 2) for i in range(12_500)]
    lab = spark.createDataFrame(rows, "doc_id long, toxic int")
    lm = lab.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")).withColumn("f", fold("id", 5)).filter("f in (1, 2, 3)")
    lm = lm.unionByName(spark.range(20_001, 34_001, 2).select("id", F.lit(1).alias("y"), fold("id", 5).alias("f")).filter("f in (1, 2, 3)"))
    lab = lab.unionByName(spark.range(20_001, 34_001, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")))
    all_ids = {r["id"] for r in lm.filter("y = 1").collect()}
    left_out = all_ids - {r["id"] for r in bounded_ids(lm, 1, 4096, toxicity.SEED).collect()}
    assert len(left_out) > 200
    docs = [(r["doc_id"], f"plain text {r['doc_id']}" + (" grobl" if r["toxic"] else " fine")
             + (" vexx" if r["doc_id"] in left_out else "")) for r in lab.collect()]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), lab)
    word, _ = toxicity.tokens(np.frombuffer(b"vexx", np.uint8), np.array([0, 4]))
    at = np.flatnonzero(model.words == word[0])
    assert len(at) == 1 and model.ratio[at[0]] > 0


def test_toxicity_counts_beyond_any_bound(spark):
    """More than 65,536 documents of a class fit the models and more than 1,024 the curve."""
    lab = spark.range(240_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    folds = lab.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), fold("doc_id", 5).alias("f"))
    lm = folds.filter("f in (1, 2, 3) and y = 1").select("id", "y")
    rest = lm.join(bounded_ids(lm, 1, 65_536, toxicity.SEED), "id", "left_anti").select("id", F.lit(" vexx").alias("more"))
    assert rest.count() > 100
    docs = (lab.withColumnRenamed("doc_id", "id").join(rest, "id", "left").select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("plain text "), "id", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("toxic") * 8 + 1, " grobl").otherwise(" fine"),
                 F.coalesce("more", F.lit(""))).alias("text")))
    model = toxicity.train(docs, lab)
    word, _ = toxicity.tokens(np.frombuffer(b"vexx", np.uint8), np.array([0, 4]))
    assert model.words[np.flatnonzero(model.words == word[0])].tolist() == word.tolist()
    # the curve is the optimum over all rows of the last fold
    cal = docs.join(folds.filter("f = 4").withColumnRenamed("id", "doc_id"), "doc_id").select("text", "y").toPandas()
    data = [t.encode() for t in cal["text"]]
    x = model.evidence(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y = cal["y"].to_numpy()
    scale = np.append(np.abs(x[:, :-1]).mean(axis=0), 1)
    p = 1 / (1 + np.exp(-(x @ model.curve)))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    slope = (x / scale).T @ (weight * (y - p)) / len(y) - 1e-3 * np.append((model.curve * scale)[:-1], 0)
    assert len(y) > 40_000 and np.abs(slope).max() < 1e-7


def test_quality(spark):
    rng = random.Random(6)
    words = word_list(rng, "abcdefghijklmno", 500)
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(8, 200))]
        y = int(rng.random() < 0.8)
        junk = rng.randrange(3)
        if not y:
            w = ([x + "%%%" for x in w], [x.upper() + "!!" for x in w], [w[0]] * len(w))[junk]
        docs.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, y))
    truth = dict(labels)
    docs += [(5000, ""), (5001, None), (None, "a b"), docs[0]]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(d, lab).collect()}
    held = [i for i in truth if brute.fold(i, 5) == 0]
    assert brute.auc([got[i] for i in held], [truth[i] for i in held]) > 0.97
    assert got[5000] == got[5001] and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in quality.classify(d, lab.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(d, lab.filter("quality = 1")).collect()} == {1.0}
    assert quality.classify(d.limit(0), lab).count() == 0


def test_discriminant_matches_a_direct_density():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = [rng.normal(size=(400, d)), rng.normal(size=(300, d)) * 2 + 1]
    m = quality.Model().fit(np.array([400.0, 300.0]), np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]))
    probe = rng.normal(size=(20, d))
    dens = []
    for (mean, inv, _), _ in zip(m.classes, x):
        cov = np.linalg.inv(inv.T @ inv)
        dens.append([-0.5 * (p - mean) @ np.linalg.solve(cov, p - mean) - 0.5 * np.linalg.slogdet(cov)[1] for p in probe])
    want = 1 / (1 + np.exp(np.clip(np.array(dens[0]) - np.array(dens[1]), -500, 500)))
    assert np.allclose(m.score(probe), want, atol=1e-9)


def test_language_id(spark):
    rng = random.Random(7)
    vocab = {"aa": word_list(rng, "abcde", 300), "bb": word_list(rng, "cdefgh", 300), "ñu": word_list(rng, "éñabc", 300)}
    rows = []
    for i in range(500):
        x = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[x]) for _ in range(rng.randrange(4, 80))), x if rng.random() < 0.9 else None, x))
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 %% 34 …", None), (903, "日本", None)]
    d = spark.createDataFrame([r[:3] for r in rows] + odd + [rows[0][:3]], "doc_id long, text string, lang string") \
        .withColumn("score", F.lit(9))
    model = langid.train(d, fold("doc_id", 4) != 2)
    out = langid.predict(d, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_"]
    got = {r["doc_id"]: r for r in out.collect()}
    held = [r for r in rows if brute.fold(r[0], 4) == 2]
    assert sum(got[r[0]]["lang_pred"] == r[3] for r in held) > 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in vocab
    assert all(0 <= r["score_"] <= 1 for r in got.values())
    assert langid.train(d, F.lit(False)) is None
    assert {r["lang_pred"] for r in langid.predict(d, None).collect()} == {"und"}
    assert langid.predict(d.limit(0), model).count() == 0


def test_language_of_copies_is_learned(spark):
    """Copies of few texts: the sample is cut by distinct texts, not by rows."""
    texts = {"aa": ["abc bca cab acb"], "bb": [f"def fed {x} edf" for x in ("dd", "ee", "ff")],
             "cc": [f"ghi hig igh{i}" for i in range(20)]}
    rows = [(t, x) for x, some in texts.items() for t in some * (10_000 // len(some))]
    d = spark.createDataFrame(rows, "text string, lang string")
    seen = {}
    fit, langid.fit = langid.fit, lambda samples, landmarks: seen.update(samples) or fit(samples, landmarks)
    try:
        model = langid.train(d, F.lit(True))
    finally:
        langid.fit = fit
    assert {x: sorted(t.decode() for t in some) for x, some in seen.items()} == {x: sorted(t) for x, t in texts.items()}
    got = langid.predict(d.distinct(), model)
    assert got.filter("lang = lang_pred").count() == 24


def test_nystroem_weights_equal_the_kernel_form():
    """Presence times collapsed weights is K(x, L) K(L,L)^(-1/2) beta + b."""
    rng = random.Random(8)
    texts = {x: [" ".join(word_list(rng, a, 20)).encode() for _ in range(12)] for x, a in (("a", "abcd"), ("b", "cdef"))}
    m = langid.fit(texts, landmarks=6)
    probe = [" ".join(word_list(rng, "abcdef", 15)).encode() for _ in range(5)]
    p = m.presence(*langid._concat(probe))
    direct = np.array([[sum(row[i] * m.weights[i, j] for i in np.flatnonzero(row)) / math.sqrt(row.sum()) + m.bias[j]
                        for j in range(2)] for row in p])
    assert np.allclose(m.scores(*langid._concat(probe)), direct, atol=1e-4)


def test_every_language_is_learned(spark):
    """300 languages of invented words, rare and frequent ones."""
    import random

    from stockpulse.llm import langid
    rnd, rows = random.Random(8), []
    for i in range(300):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 7))) for _ in range(12)]
        for j in range(3 if i % 2 else 12):
            rows.append((len(rows), " ".join(rnd.choices(words, k=40)), f"l{i:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert len(model.langs) == 300
    got = langid.predict(df, model).select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(rows)


def test_vocabulary_keeps_a_rare_languages_grams():
    import numpy as np

    from stockpulse.llm import langid
    marks = [b"aaaa bbbb cccc dddd"] * 50 + [b"zzzz yyyy"]
    vocab = langid._vocabulary(marks, np.array([0] * 50 + [1]), 30)
    doc, code = langid.grams(*langid._concat([b"zzzz yyyy"]))
    assert len(vocab) == 30 and set(code.tolist()) <= set(vocab.tolist())
