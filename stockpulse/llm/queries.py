"""The operators as registered queries: thin wrappers that apply an operator
with production parameters to its whole table and derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockpulse.llm import (collocations, decontam, embed_dedup, langid, mixing, mtree, quality, reversed_search,
                            simhash, substr_dedup, suffix_dedup, toxicity, url_filter)
from stockpulse.llm.sampling import fold
from stockpulse.session import ship_package


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept (and the audited recall)."""
    out = embed_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"), F.col("recall").alias("audited_recall"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out = substr_dedup.remove_repeated_words(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), keep=["page_id"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = simhash.near_duplicate_classes(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold("doc_id", quality.FOLDS) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = suffix_dedup.remove_repeated_bytes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (and copies)."""
    out = mixing.mix(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             (2 * source_size)::DOUBLE AS cap, sum(source_size) OVER () AS words FROM s),
l AS (SELECT *, 1.5::DOUBLE * words::DOUBLE - (sum(cap) OVER o - cap) AS num,
             sum(weight) OVER () - (sum(weight) OVER o - weight) AS den,
             row_number() OVER o AS pos
      FROM r WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
f AS (SELECT arg_min(num, pos) AS num0, arg_min(den, pos) AS den0, min(pos) AS pos0 FROM l WHERE num * weight <= cap * den),
t AS (SELECT source, source_size,
             CASE WHEN pos0 IS NOT NULL AND pos >= pos0 THEN least(cap, weight * num0 / den0) ELSE cap END AS target
      FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
             2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) - d.size
               < 2 * (p.target - p.whole * p.source_size) AS more
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (whole + more::BIGINT) AS taken, whole + more::BIGINT AS copies FROM x
"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontam.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
b AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC) AS k
      FROM p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(p.host, '^(.*[.-])?(spam-farm|cheap-pills)[.]') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT DISTINCT * FROM b WHERE k = 1) b
  ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    out = mtree.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS q, row_number() OVER () AS line
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.line, a.vec_id AS query_id, b.vec_id,
             list_sum([p[1] * p[2] for p in list_zip(a.q, b.q)])::BIGINT AS score
      FROM v a JOIN v b ON a.line <> b.line AND len(a.q) = len(b.q) AND a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
WHERE rank <= 20
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return collocations.mine(_read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES (1), (2), (3)) AS t(m)
      WHERE i + m - 1 <= len(words) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS words, f AS a FROM g WHERE m > 1 AND f >= 10),
k AS (SELECT c.*, unnest(range(1, m)) AS cut FROM c),
x AS (SELECT k.lang, k.m, k.phrase, k.words, k.a, cut, l.f AS l, r.f AS r,
             ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.words[1:cut], ' ')
             JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.words[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(a) AS longer
      FROM (SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a
            FROM c WHERE m = 3) GROUP BY 1, 2),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
      FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score."""
    out = reversed_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS line,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
f AS (SELECT line, doc_id, len(terms) AS n, term, count(*) AS tf
      FROM (SELECT line, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, docs),
x AS (SELECT item_id, text, line, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN w USING (term), s GROUP BY 1, 2, 3, 4)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM x WHERE score > 0) WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_substring_dedup, op3_url_filters, op4_toxicity, op5_simhash_near_dedup,
    op6_quality, op7_suffix_array_dedup, op8_mix_sources, op9_benchmark_decontamination, op10_language_id,
    op11_exact_top_k, op12_collocations, op13_ranked_search)}
SQL: dict[str, str] = {"op3_url_filters": OP3_SQL, "op8_mix_sources": OP8_SQL, "op11_exact_top_k": OP11_SQL,
                       "op12_collocations": OP12_SQL, "op13_ranked_search": OP13_SQL}
