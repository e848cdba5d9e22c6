"""Toxicity scores from two Kneser-Ney language models.

The history of a word is its document's class: P(w | class) is the class's count
less an absolute discount, plus the discounted mass times one distribution that the
classes share, whose counts are continuation counts (in how many classes a word
occurs). A word counts once per document and copies of a text are one document.
Words seen once are left to the shared level, words in neither model say nothing,
and of a log ratio only what is beyond its counts' error is used, so rare
expressions say little. (Longer histories, class and word before, were measured and
lowered the held-out accuracy; the README has the figures.) A text's score compares
the two log-likelihoods, normalised by the number of words and by its root; a
logistic curve fitted on rows the models have not seen turns that into 0 to 1.

All labelled documents of the learning folds count: the last fold fits the curve, the others
the models (a caller may bound both, to those with the least seeded id hash). A bit per
hash of a labelled id is broadcast, in a table of a bounded size, so that few texts but the
labelled ones leave the scan; the join behind it is exact. The curve's sums over its rows
are one aggregation a step. Ratios are computed in the tasks, and only the words that keep
a weight are collected and sent to the scoring tasks. Every whole text is scored.

Defined results: null, empty and wordless texts get the curve's value at zero
evidence; without toxic or without ordinary labelled documents every score is the
share of toxic labels (0 without any label); repeated rows score alike; of contradicting
labels 1 holds; a null id belongs to no label; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.sampling import bounded_ids, fold, label_of
from stockpulse.llm.scratch import unused, written

FOLDS = 5
SEED = 4
MIN_COUNT = 2
ERRORS = 2.0             # standard errors of a log ratio that are taken off it
LEAST_RATIO = 1.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each document)."""
    data = bs.LOWER[data]
    start, end, first = bs.words(data, offsets, bs.ALNUM)
    return bs.word_hashes(data, start, end), first


def _count_words(batches):
    """Documents per class that contain each word."""
    for batch in batches:
        for part in bs.slices(batch, "text"):
            w, first = tokens(*bs.text_column(part.column("text")))
            if not len(w):
                continue
            y = np.repeat(np.asarray(part.column("y")), np.diff(first))
            doc = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(first))
            # a document counts once for a word, however often it repeats it
            once = np.unique(bs.mix(w + doc * np.uint64(bs.BASE)), return_index=True)[1]
            kept, inv = np.unique(w[once], return_inverse=True)
            c1 = np.bincount(inv, weights=y[once], minlength=len(kept)).astype(np.int64)
            c = np.bincount(inv, minlength=len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(c - c1), pa.array(c1)],
                                             ["w", "c0", "c1"])


class Model:
    """Log-likelihood ratios by sorted word hash, and the curve."""

    def __init__(self) -> None:
        self.words, self.ratio = np.zeros(0, np.uint64), np.zeros(0)
        self.curve = np.zeros(3)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per document: (ratio / words, ratio / root of words, 1)."""
        w, first = tokens(data, offsets)
        n = np.diff(first)
        i = bs.lookup(self.words, w)
        r = np.append(self.ratio, 0)[i]            # words neither model knows say nothing
        acc = np.append(0, np.cumsum(r))
        total = acc[first[1:]] - acc[first[:-1]]
        n = np.maximum(n, 1)
        return np.stack([total / n, total / np.sqrt(n), np.ones(len(n))], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.evidence(data, offsets) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _ratios(n0: int, n1: int, classes: int, d0: float, d1: float, left: float):
    """Class totals, class-word types, discounts and the backoff weight -> the words
    whose log ratio of the two models keeps a weight."""
    def run(batches):
        for batch in batches:
            c0, c1 = (np.asarray(batch.column(c)).astype(float) for c in ("c0", "c1"))
            shared = ((c0 > 0).astype(float) + (c1 > 0)) / max(classes, 1)
            p0, p1 = (np.maximum(c - d, 0) / max(n, 1) + left * shared for c, n, d in ((c0, n0, d0), (c1, n1, d1)))
            r = beyond_error(np.log(p1 / p0), c0, c1)
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(r)], ["w", "r"]).filter(pa.array(r != 0))
    return run


def beyond_error(ratio: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """The part of a log ratio beyond ERRORS standard errors of its counts; none
    of a ratio under LEAST_RATIO, which is topic or language rather than toxicity."""
    se = np.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5))
    return np.where(np.abs(ratio) >= LEAST_RATIO, np.sign(ratio) * np.maximum(np.abs(ratio) - ERRORS * se, 0), 0)


def logistic(rows: DataFrame, ridge: float = 1e-3) -> np.ndarray:
    """The curve's coefficients of a, b and 1 from rows (y, a, b), classes weighing alike: Newton's
    method on scaled columns; the sums of a step are one aggregation over all rows."""
    of = rows.agg(F.count(F.lit(1)), F.avg("y"), F.avg(F.abs("a")), F.avg(F.abs("b"))).first()
    n, mean = of[0], of[1]
    scale = np.append(np.maximum(of[2:], 1e-9), 1)
    x = [F.col("a") / float(scale[0]), F.col("b") / float(scale[1]), F.lit(1.0)]
    weight = F.when(F.col("y") == 1, 0.5 / max(mean, 1e-9)).otherwise(0.5 / max(1 - mean, 1e-9))
    beta = np.zeros(3)
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(50):
        z = sum(x[i] * F.lit(float(beta[i])) for i in range(3))
        at = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], weight.alias("w"), "y",
                         (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).alias("p"))
        curved = F.col("w") * F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))
        sums = np.array(at.agg(*[F.sum(F.col("w") * (F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(3)],
                               *[F.sum(curved * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in upper]).first()) / n
        g = sums[:3] - ridge * np.append(beta[:-1], 0)
        h = ridge * np.eye(3)
        for (i, j), v in zip(upper, sums[3:]):
            h[i, j] += v
            h[j, i] = h[i, j]
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def _may_be_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) whose id may be among `ids`, and a few others: a bit for each hash is looked
    up, 64 in a row of a table of 2**20 rows at most, which is broadcast. Ids of two types, which
    hash differently, are left to the join."""
    if docs.schema["id"].dataType != ids.schema["id"].dataType:
        return docs
    h = F.xxhash64(F.lit(SEED), "id")
    place, bit = F.shiftrightunsigned(h, 44), F.expr("shiftleft(1L, cast(h & 63 as int))")
    of = lambda df: df.withColumn("h", h).withColumn("place", place).withColumn("bit", bit)
    bits = of(ids.select("id")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    return of(docs).join(F.broadcast(bits), "place").filter("bits & bit <> 0").select("id", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", calibrate_docs: int | None = None, model_docs: int | None = None) -> Model:
    """Learns from all labelled ids of all folds but 0; the last fold fits the curve. With limits, from
    at most that many of each class."""
    lab = (label_of(labels, id_col, label_col).withColumn("f", fold("id", FOLDS)).filter("f <> 0")
           .select("id", "y", (F.col("f") == FOLDS - 1).cast("int").alias("cal")))
    for c, limit in ((0, model_docs), (1, calibrate_docs)):
        if limit is not None:
            mine = lab.filter(F.col("cal") == c)
            bounded = [bounded_ids(mine, y, limit, SEED).withColumn("cal", F.lit(c)) for y in (0, 1)]
            lab = lab.filter(F.col("cal") != c).unionByName(bounded[0]).unionByName(bounded[1])
    lab = written(lab, "toxic-ids")
    # copies of one text are one document of the sample
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = written(_may_be_among(texts, lab).join(lab.hint("merge"), "id").groupBy(F.xxhash64("text").alias("h"), "y", "cal")
                     .agg(F.min("text").alias("text")), "toxic-sample")
    counts = written(sample.filter("cal = 0").select("y", "text").mapInArrow(_count_words, "w long, c0 long, c1 long")
                     .groupBy("w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "toxic-counts")
    a = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in ("c0", "c1")],
                   *[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("c0", "c1") for k in (1, 2)],
                   (F.count_if(F.col("c0") > 0) + F.count_if(F.col("c1") > 0)).alias("classes")).first()
    if not a["n_c0"] or not a["n_c1"]:
        share = lab.agg(F.avg("y")).first()[0] or 0.0
        m = Model()
        m.curve = np.array([0, 0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
        return m
    d0, d1 = _discount(a["c0_1"], a["c0_2"]), _discount(a["c1_1"], a["c1_2"])
    known = counts.filter(f"c0 + c1 >= {MIN_COUNT}")
    direct = known.agg(*[F.coalesce(F.sum(F.greatest(F.col(c) - F.lit(d), F.lit(0.0))), F.lit(0.0)).alias(c)
                         for c, d in (("c0", d0), ("c1", d1))]).first()
    # one backoff weight for both classes
    left = max(1 - (direct["c0"] / a["n_c0"] + direct["c1"] / a["n_c1"]) / 2, 1e-9)
    u = known.mapInArrow(_ratios(a["n_c0"], a["n_c1"], a["classes"], d0, d1, left), "w long, r double").toArrow()
    words, ratio = np.asarray(u.column("w").combine_chunks()).view(np.uint64), np.asarray(u.column("r").combine_chunks())
    order = np.argsort(words)
    m = Model()
    m.words, m.ratio = words[order], ratio[order]
    # without unseen rows of both classes the curve falls back to the models' own sample
    both = sample.filter("cal = 1").select("y").distinct().count() == 2
    shared = docs.sparkSession.sparkContext.broadcast(m)
    m.curve = logistic(written((sample.filter("cal = 1") if both else sample).select("y", "text").mapInArrow(
        _evidence(shared), "y int, a double, b double"), "toxic-evidence"))
    return m


def _discount(n1, n2) -> float:
    """n1 / (n1 + 2 n2) from the numbers of counts of one and two; 0.75 where undefined."""
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


def _evidence(shared):
    def run(batches):
        for batch in batches:
            for part in bs.slices(batch, "text"):
                x = shared.value.evidence(*bs.text_column(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "a", "b"])
    return run


def _score(shared, text, name):
    def run(batches):
        for batch in batches:
            for part in bs.slices(batch, text):
                s = shared.value.score(*bs.text_column(part.column(text)))
                keep = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(s)], [*keep, name])
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the text) and score."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    name = unused("score", keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep, text_col).mapInArrow(_score(shared, text_col, name), schema)
