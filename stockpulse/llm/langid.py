"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (n = 1..3, letters lower-cased,
anything else one blank) present in both, divided by the root of the product of
their numbers (blended-spectrum presence kernel). Landmark documents give the
Nystroem features K(x, L) K(L, L)^(-1/2); one ridge regression per language against the
rest is fitted on a bounded sample. The n-grams are those of the landmarks. A
batch of documents is scored by matrix products: presence times landmarks times
weights, where the last two are multiplied once.

Bounds, all parameters: `landmarks` and `train_docs` documents per language, or an equal share of
`all_landmarks` and `all_train_docs` where there are many languages; `gram_limit` n-grams, those in
most landmarks of each language in turn. They bound the model, not the scoring: every
language is learned and every whole text is scored.

Defined results: `und` with score 0 if the text is null or has no letter, or if
nothing could be learned; ties go to the smaller language value; null languages
are not learned from; repeated rows are scored alike; other columns pass through;
an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.scratch import unused

LANDMARKS = 64
TRAIN_DOCS = 1024
ALL_LANDMARKS = 1024     # of all languages together, one each at least
ALL_TRAIN_DOCS = 32_768
GRAM_LIMIT = 20_000
RIDGE = 1e-3
SEED = 10
BATCH_DOCS = 128         # documents in a matrix product
UND = "und"

# Alphabet of the n-grams: blank 0, a-z 1..26, bytes >= 0x80 27..154.
SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[0x61:0x7B] = np.arange(1, 27)
SYMBOL[0x41:0x5B] = np.arange(1, 27)
SYMBOL[0x80:] = np.arange(27, 155)
SIZE = 155


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of every n-gram, n = 1..3, codes of different n apart.
    Runs of blanks are one blank; n-grams of blanks only are left out."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = SYMBOL[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = s > 0
    keep[1:] |= (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    two = np.full(len(s), -1, dtype=np.int64)
    three = two.copy()
    same = doc[1:] == doc[:-1]
    two[:-1][same] = (s[:-1] * SIZE + s[1:])[same]
    same3 = same[:-1] & same[1:]
    three[:-2][same3] = ((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:])[same3]
    one_ok, two_ok, three_ok = s > 0, two > 0, three >= 0
    return (np.concatenate([doc[one_ok], doc[two_ok], doc[three_ok]]),
            np.concatenate([s[one_ok], SIZE + two[two_ok], SIZE + SIZE * SIZE + three[three_ok]]))


CODES = SIZE + SIZE ** 2 + SIZE ** 3


class Model:
    """Languages, the n-gram index and the weight of every n-gram per language."""

    def __init__(self, langs: list[str], vocab: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.vocab, self.weights, self.bias = langs, vocab, weights.astype(np.float32), bias
        self._index = None

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self._index is None:
            self._index = np.full(CODES, -1, dtype=np.int32)
            self._index[self.vocab] = np.arange(len(self.vocab))
        doc, code = grams(data, offsets)
        col = self._index[code]
        have = col >= 0
        out = np.zeros((len(offsets) - 1, len(self.vocab)), dtype=np.float32)
        out[doc[have], col[have]] = 1
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p = self.presence(data, offsets)
        norm = np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))
        return (p @ self.weights) / norm + self.bias

    def __getstate__(self):
        return {**self.__dict__, "_index": None}


def _concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def fit(samples: dict[str, list[bytes]], landmarks: int = LANDMARKS, gram_limit: int = GRAM_LIMIT,
        ridge: float = RIDGE, all_landmarks: int = ALL_LANDMARKS) -> Model | None:
    """samples: texts per language, the first `landmarks` of each are landmarks."""
    langs = sorted(x for x in samples if samples[x])
    if not langs:
        return None
    each = max(1, min(landmarks, all_landmarks // len(langs)))
    marks = [t for x in langs for t in samples[x][:each]]
    of = np.repeat(np.arange(len(langs)), [len(samples[x][:each]) for x in langs])
    vocab = _vocabulary(marks, of, gram_limit)
    if len(vocab) == 0:
        return None
    model = Model(langs, vocab, np.zeros((len(vocab), len(langs))), np.zeros(len(langs)))

    def unit(texts):
        p = model.presence(*_concat(texts))
        return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    land = unit(marks).astype(np.float64)
    kll = land @ land.T
    val, vec = np.linalg.eigh(kll)
    ok = val > 1e-8 * max(val.max(), 1e-12)
    half = vec[:, ok] / np.sqrt(val[ok])                       # K(L,L)^(-1/2) on its range
    gram = np.zeros((int(ok.sum()) + 1, int(ok.sum()) + 1))
    rhs = np.zeros((int(ok.sum()) + 1, len(langs)))
    total = 0
    for j, x in enumerate(langs):
        for a in range(0, len(samples[x]), 256):
            z = (unit(samples[x][a:a + 256]) @ land.T) @ half  # Nystroem features
            z = np.hstack([z, np.ones((len(z), 1))])
            w = 1.0 / len(samples[x])                          # every language weighs the same
            y = -np.ones((len(z), len(langs)))
            y[:, j] = 1
            gram += w * z.T @ z
            rhs += w * z.T @ y
            total += 1
    reg = ridge * np.eye(len(gram))
    reg[-1, -1] = 1e-9
    beta = np.linalg.solve(gram + reg, rhs)
    model.weights = (land.T @ half @ beta[:-1]).astype(np.float32)
    model.bias = beta[-1]
    return model


def _vocabulary(marks: list[bytes], of: np.ndarray, limit: int) -> np.ndarray:
    """The n-grams of the landmarks (of: their languages); over the limit the first of every
    language in turn, so that no language is thinned out by others."""
    doc, code = grams(*_concat(marks))
    held = np.unique(code * len(marks) + doc)
    vocab, at, df = np.unique(held // len(marks), return_inverse=True, return_counts=True)
    if len(vocab) <= limit:
        return vocab
    langs = int(of.max()) + 1
    pair, n = np.unique(at * langs + of[held % len(marks)], return_counts=True)
    gram, lang = pair // langs, pair % langs
    # every language ranks its n-grams by how many of its landmarks hold them; the best rank counts
    order = np.lexsort((gram, -n, lang))
    place = np.arange(len(order)) - np.searchsorted(lang[order], lang[order])
    rank = np.full(len(vocab), len(pair))
    np.minimum.at(rank, gram[order], place)
    return np.sort(vocab[np.lexsort((vocab, -df, rank))[:limit]])


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(model, text: str, names: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in bs.slices(batch, text, 256 << 10):
                data, offs = bs.text_column(part.column(text))
                n = part.num_rows
                pred, score = np.full(n, UND, dtype=object), np.zeros(n)
                ascii_letter = np.append(0, np.cumsum((SYMBOL[data] > 0) & (data < 0x80)))
                letters = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
                for i in np.flatnonzero(~letters):
                    if offs[i + 1] > offs[i]:
                        letters[i] = has_letter(data[offs[i]:offs[i + 1]].tobytes().decode())
                if m is not None and letters.any():
                    for a in range(0, n, BATCH_DOCS):
                        b = min(a + BATCH_DOCS, n)
                        raw = m.scores(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
                        best = raw.argmax(axis=1)
                        top = raw[np.arange(b - a), best]
                        ok = letters[a:b]
                        pred[a:b][ok] = np.array(m.langs, dtype=object)[best[ok]]
                        score[a:b][ok] = np.clip((top[ok] + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in part.schema.names]
                    + [pa.array(pred.tolist(), pa.string()), pa.array(score)], [*part.schema.names, *names])
    return run


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang",
          landmarks: int = LANDMARKS, train_docs: int = TRAIN_DOCS, all_train_docs: int = ALL_TRAIN_DOCS) -> Model | None:
    """Fit on a sample of the `usable` rows: at most train_docs distinct texts per
    language, those whose seeded hash is least. The hashes are cut off per language
    from the number of distinct texts first, so a language of any size sends few rows
    and copies of one text thin out no others. All languages are sampled by one job; the table of
    cuts has a row per language, as the model has."""
    rows = (docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(F.lit(SEED), text_col).alias("u")))
    counts = rows.groupBy("lang", "u").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("texts")).collect()
    if not counts:
        return None
    each = max(1, min(train_docs, all_train_docs // len(counts)))
    cuts = []
    for r in counts:
        cut = int(-(1 << 63) + min(1.0, (1.5 * each + 16) / r["texts"]) * ((1 << 64) - 1))
        cuts.append((r["lang"], min(cut, (1 << 63) - 1)))
    least = Window.partitionBy("lang").orderBy("u")
    # copies of one text have one hash: distinct texts only, so a group of copies is one sample
    drawn = (rows.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long")), "lang")
             .filter(F.col("u") <= F.col("cut")).groupBy("lang", "u").agg(F.min("t").alias("t"))
             .withColumn("r", F.row_number().over(least)).filter(F.col("r") <= each).select("lang", "u", "t"))
    samples: dict[str, list[bytes]] = {}
    for lang, _, t in sorted((r["lang"], r["u"], r["t"]) for r in drawn.toLocalIterator()):
        samples.setdefault(lang, []).append(t.encode())
    return fit(samples, landmarks)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns plus lang_pred and score (names get underscores on a clash)."""
    names = []
    for c in ("lang_pred", "score"):
        names.append(unused(c, docs.columns + names))
    schema = T.StructType(docs.schema.fields + [T.StructField(names[0], T.StringType()),
                                                T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared, text_col, names), schema)
