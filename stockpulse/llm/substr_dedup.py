"""Substring dedup over words: super-k-mer partitioning.

Windows of `k` words that share a minimiser travel as one packed string to the
minimiser's bucket, where sorting counts them exactly (`repeats.py` has the
stages). Every word in a window that also starts anywhere else, in the same
document too, is removed; windows are judged on the input.

Defined results: a null text has no words; empty texts and texts of fewer than
`k` words lose nothing; repeated rows (same id and text) are documents of their
own, so their windows repeat; null ids are kept; other columns, whatever their
names, pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.repeats import Units, covered, repeated_starts
from stockpulse.llm.scratch import unused

WINDOW_WORDS = 35
MINIMISER_WORDS = 8


def _scan(data, offs):
    start, end, first = bs.words(data, offs, bs.NOT_SPACE)
    return bs.word_hashes(data, start, end), first


def _pack(raw: bytes):
    ws = raw.split()               # splits at exactly the ASCII white space bytes
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1 if ws else np.zeros(0, np.int64)
    begins = np.append(0, ends[:-1] + 1) if ws else ends
    return b" ".join(ws), begins.tolist(), ends.tolist()


def _count(rows, k):
    """Sort all windows of the bucket's strings and count neighbours that are equal."""
    wins = []
    for r, (p, w) in enumerate(rows):
        packed, begin, end = _pack(p)
        wins += [(packed[begin[j]:end[j + k - 1]], r, j, w) for j in range(len(begin) - k + 1)]
    wins.sort(key=lambda x: x[0])
    out = []
    for _, same in groupby(wins, key=lambda x: x[0]):
        same = list(same)
        if len(same) > 1 or same[0][3] > 1:
            out += [(r, j) for _, r, j, _ in same]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def word_units(k: int = WINDOW_WORDS, m: int = MINIMISER_WORDS) -> Units:
    return Units("words", k, min(m, k), _scan, _pack, _count)


def _finish(key: str, text: str, spans: str, k: int, names: list[str]):
    def run(batches):
        for batch in (part for whole in batches for part in bs.slices(whole, text)):
            docs = [t.encode().split() if t else [] for t in batch.column(text).to_pylist()]
            n_words = np.array([len(ws) for ws in docs])
            marks = batch.column(spans)
            rows = np.flatnonzero(np.asarray(marks.is_valid()))
            gone = covered(marks, rows, n_words, k)
            begin = np.append(0, np.cumsum(n_words))
            n_removed = np.diff(np.append(0, np.cumsum(gone))[begin])
            for d in np.flatnonzero(n_removed):
                docs[d] = [w for w, g in zip(docs[d], gone[begin[d]:begin[d + 1]].tolist()) if not g]
            kept = [b" ".join(ws) for ws in docs]
            keep = [c for c in batch.schema.names if c not in (key, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                   pa.array([b.decode() for b in kept], pa.string())], [*keep, *names])
    return run


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          k: int = WINDOW_WORDS, bucket_windows: int = 50_000) -> DataFrame:
    """All columns of `docs` plus n_words, n_removed and kept_text (the kept
    words joined by one space; null text: empty). If `docs` has columns of these
    names, underscores are added to the new ones."""
    key = unused("row_key", docs.columns)
    spans = unused("row_spans", docs.columns)
    names = []
    for c in ("n_words", "n_removed", "kept_text"):
        names.append(unused(c, docs.columns + names))
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = (repeated_starts(keyed, key, text_col, word_units(k), bucket_windows)
             .select(F.col("k").alias(key), F.col("spans").alias(spans)))
    schema = T.StructType(docs.schema.fields + [T.StructField(names[0], T.LongType()),
                                                T.StructField(names[1], T.LongType()),
                                                T.StructField(names[2], T.StringType())])
    joined = keyed.join(found, key, "left")
    return joined.mapInArrow(_finish(key, text_col, spans, k, names), schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
