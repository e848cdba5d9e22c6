"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text gives a vector of transformed statistics (lengths, character class
shares, repetition, word shapes; logs and roots make them closer to normal). Per
class the mean and covariance are estimated from all labelled rows of the learning
folds - as sums, combined before the shuffle - and the covariances are shrunk
towards the pooled one and its diagonal. The score is the posterior of class 1:
Mahalanobis distances from cached Cholesky factors, log-determinants and priors.

Defined results: null and empty texts have the statistics of an empty text and are
scored like any other; a class without labelled rows gives the other one's score
(1 or 0), no labels at all 0.5; repeated rows score alike; of contradicting labels
1 holds; null ids belong to no label; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.sampling import fold, label_of
from stockpulse.llm.scratch import unused, written

FOLDS = 5
POOLED = 0.15          # weight of the pooled covariance
DIAGONAL = 0.05        # weight of its diagonal
FLOOR = 1e-4           # variance added to every statistic
EVEN_PRIOR = 0.5       # classes count alike, so the rarer one is found

# character classes of bytes
_CLASS = np.full(256, 7, dtype=np.int64)                  # other symbols
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0                # blanks
_CLASS[0x0A] = 1                                          # line ends
_CLASS[0x61:0x7B] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 5               # ordinary punctuation
_CLASS[0x80:] = 6
NAMES = ["log_words", "upper", "digit", "punctuation", "symbol", "non_ascii", "line_ends", "word_length",
         "distinct_words", "top_word", "repeated_next", "symbol_words", "upper_words", "long_words",
         "stop_per_word", "run_symbols"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per document."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if len(data) == 0:
        return out
    cls = _CLASS[data]

    def per_doc(mask):
        acc = np.append(0, np.cumsum(mask))
        return acc[offsets[1:]] - acc[offsets[:-1]]

    start, end, first = bs.words(data, offsets, bs.NOT_SPACE)
    words = np.diff(first)
    w1 = np.maximum(words, 1)
    ink = np.maximum(per_doc(cls > 1), 1)

    def per_word(mask):
        acc = np.append(0, np.cumsum(mask))
        return acc[first[1:]] - acc[first[:-1]]

    def in_word(mask):
        acc = np.append(0, np.cumsum(mask))
        return acc[end] - acc[start]

    length = end - start
    h = bs.word_hashes(data, start, end)
    doc = np.repeat(np.arange(n), words)
    key = bs.mix(h ^ (doc.astype(np.uint64) * np.uint64(bs.BASE)))
    order = np.argsort(key, kind="stable")
    ks = key[order]
    heads = np.flatnonzero(np.append(True, ks[1:] != ks[:-1])) if len(ks) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(ks)))
    head_doc = doc[order[heads]] if len(ks) else np.zeros(0, np.int64)
    distinct = np.bincount(head_doc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, head_doc, sizes)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    symbols, uppers, letters = in_word(cls == 7), in_word(cls == 3), in_word((cls == 2) | (cls == 6))
    run = np.zeros(len(data), dtype=bool)
    run[1:] = (cls[1:] == 7) & (cls[:-1] == 7)
    ends_sentence = (data[end - 1] == 0x2E) | (data[end - 1] == 0x3F)
    root = np.sqrt
    out[:] = np.stack([
        np.log1p(words), root(per_doc(cls == 3) / ink), root(per_doc(cls == 4) / ink),
        root(per_doc(cls == 5) / ink), root(per_doc(cls == 7) / ink), root(per_doc(cls == 6) / ink),
        root(per_doc(cls == 1) / w1), np.log1p(per_word(length) / w1),
        distinct / root(w1) / (1 + np.log1p(w1)), root(top / w1), root(per_word(again) / w1),
        root(per_word(symbols > 0) / w1), root(per_word((uppers > 1) & (letters == 0)) / w1),
        root(per_word(length > 18) / w1), root(per_word(ends_sentence) / w1), root(per_doc(run) / ink)], axis=1)
    return out


class Model:
    """Class means, cached Cholesky factors and log-density constants."""

    def __init__(self, prior: float = 0.5) -> None:
        self.prior, self.classes = prior, None

    def fit(self, n, total, outer, even: bool = True) -> Model:
        """n[c], total[c] = sum of x, outer[c] = sum of x x' per class c."""
        self.prior = n[1] / max(n[0] + n[1], 1) if n[0] + n[1] else 0.5
        if not n[0] or not n[1]:
            return self
        cov, mean = [], []
        for c in (0, 1):
            mean.append(total[c] / n[c])
            cov.append(outer[c] / n[c] - np.outer(mean[c], mean[c]))
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.classes = []
        for c in (0, 1):
            own = n[c] / (n[c] + len(mean[c])) * (1 - POOLED - DIAGONAL)     # few rows: more shrinkage
            s = own * cov[c] + (1 - own - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
            low = np.linalg.cholesky(s + FLOOR * np.eye(len(s)))
            prior = EVEN_PRIOR if even else n[c] / (n[0] + n[1])
            self.classes.append((mean[c], np.linalg.inv(low), -np.log(np.diag(low)).sum() + np.log(prior)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), float(self.prior))
        dens = [const - 0.5 * (((x - mean) @ inv.T) ** 2).sum(axis=1) for mean, inv, const in self.classes]
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -500, 500)))


def _stat_rows(text: str, name: str):
    def run(batches):
        for batch in batches:
            for part in bs.slices(batch, text):
                x = statistics(*bs.text_column(part.column(text)))
                keep = [c for c in part.schema.names if c != text]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)),
                                                 pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists], [*keep, name])
    return run


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats",
                    keep: list[str] | None = None) -> DataFrame:
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.select(*keep, text_col).mapInArrow(_stat_rows(text_col, name), schema)


def _sums(batches):
    """Sums of x and x x' per class of one task's rows."""
    d = len(NAMES)
    n, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        x = np.asarray(batch.column("stats").flatten()).reshape(-1, d)
        y = np.asarray(batch.column("y"))
        for c in (0, 1):
            z = x[y == c]
            n[c] += len(z)
            total[c] += z.sum(axis=0)
            outer[c] += z.T @ z
    yield pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int32()), pa.array(n),
         pa.array([np.concatenate([total[c], outer[c].reshape(-1)]).tolist() for c in (0, 1)],
                  pa.list_(pa.float64()))], ["y", "n", "s"])


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """stats: id and `stats`. Learns from labelled ids of all folds but 0."""
    lab = label_of(labels, id_col, label_col).filter(fold("id", FOLDS) != 0)
    rows = stats.select(F.col(id_col).alias("id"), "stats").join(lab, "id").select("y", "stats")
    d = len(NAMES)
    parts = rows.mapInArrow(_sums, "y int, n double, s array<double>")
    sums = (parts.groupBy("y").agg(F.sum("n").alias("n"),
                                   *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d + d * d)])).collect()
    n, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums:
        v = np.array([r[f"s{i}"] for i in range(d + d * d)], dtype=float)
        n[r["y"]], total[r["y"]], outer[r["y"]] = r["n"], v[:d], v[d:].reshape(d, d)
    return Model().fit(n, total, outer)


def _score(shared, name):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, len(NAMES))
            keep = [c for c in batch.schema.names if c != "stats"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep]
                                             + [pa.array(shared.value.score(x))], [*keep, name])
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """(id, score): statistics are computed once, written, and used to fit and to score."""
    stats = written(with_statistics(docs.select(id_col, text_col), text_col), "quality-stats")
    shared = docs.sparkSession.sparkContext.broadcast(train(stats, labels, id_col, label_col))
    name = unused("score", [id_col])
    schema = T.StructType([docs.schema[id_col], T.StructField(name, T.DoubleType())])
    return stats.mapInArrow(_score(shared, name), schema)
