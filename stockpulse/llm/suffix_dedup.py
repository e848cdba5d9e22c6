"""Suffix-array dedup over bytes by prefix-free parsing.

A byte is removed if a `k`-byte string that covers it also starts anywhere else.
Equal strings are brought together as in `repeats.py` (byte units; the rolling
hash of `m` bytes that is least in a string names its bucket). A bucket's strings
are put in suffix order by prefix-free parsing: a rolling hash under 2**64/p is a
trigger and ends a phrase (phrases overlap by the trigger), the distinct phrases
are the dictionary, the phrase numbers the parse. The suffix array of the
dictionary and that of the parse combine to the order of all positions: by the
rest of the phrase, which is prefix-free, then by the parse after it. Highly
repetitive text has a small dictionary, and each distinct phrase suffix is sorted
once. Neighbours in that order that agree on k bytes are repeats; the bytes are
compared.

Defined results: null text is empty; documents shorter than k bytes keep all;
matches never cross documents; repeated rows (same id and text) are documents of
their own; null ids and other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.repeats import Units, covered, repeated_starts
from stockpulse.llm.scratch import unused

WINDOW_BYTES = 200
MINIMISER_BYTES = 32
TRIGGER_BYTES = 12
TRIGGER_EVERY = 48       # mean phrase length

_BYTE_HASH = bs.mix(np.arange(1, 257, dtype=np.uint64))


def _scan(data, offs):
    return _BYTE_HASH[data], offs


def _pack(raw: bytes):
    return raw, range(len(raw)), range(1, len(raw) + 1)


def suffix_ranks(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equality-and-order rank of every suffix s[i:ends[i]] by prefix doubling
    (equal suffixes have equal ranks; a proper prefix sorts first)."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    step, at = 1, np.arange(n)
    while n:
        nxt = np.zeros(n, dtype=np.int64)
        inside = at + step < ends
        nxt[inside] = rank[at[inside] + step]
        if not nxt.any():
            break
        both = rank * (n + 2) + nxt
        new = np.unique(both, return_inverse=True)[1].astype(np.int64) + 1
        done = new.max() == rank.max()
        rank = new
        if done:
            break
        step *= 2
    return rank


def corpus_order(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Positions of all bytes in suffix order (suffixes end with their string;
    equal suffixes in any order). begin: string starts and the total length."""
    n = len(data)
    string = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    stop = begin[string + 1]
    # triggers: the last byte of a gram with a small rolling hash ends a phrase
    cut = np.zeros(n + 1, dtype=bool)
    if n >= TRIGGER_BYTES:
        at = np.arange(n - TRIGGER_BYTES + 1)
        h = bs.range_hash(_BYTE_HASH[data], at, at + TRIGGER_BYTES)
        hit = at[(h < np.uint64((1 << 64) // TRIGGER_EVERY)) & (at + TRIGGER_BYTES <= stop[at])]
        cut[hit] = True                      # a phrase starts at a trigger's first byte ...
    cut[begin[:-1][begin[:-1] < n]] = True
    p_start = np.flatnonzero(cut[:n])
    p_string = string[p_start]
    nxt = np.append(p_start[1:], n)
    same = np.append(p_string[1:] == p_string[:-1], False)
    p_end = np.where(same, nxt + TRIGGER_BYTES, begin[p_string + 1])   # ... and the one before ends with it
    # dictionary: distinct phrases; a phrase at a string's end is marked as such
    h = bs.range_hash(_BYTE_HASH[data], p_start, p_end)
    length = p_end - p_start
    _, rep, pid = np.unique(bs.mix(h + (2 * length + same).astype(np.uint64)),
                            return_index=True, return_inverse=True)
    d_len = length[rep]
    d_begin = np.append(0, np.cumsum(d_len))
    d_bytes = data[bs.runs(p_start[rep], p_end[rep])]
    d_end = np.repeat(d_begin[1:], d_len)
    d_rank = suffix_ranks(d_bytes, d_end)
    # parse: rank of every parse suffix, by the order of whole phrases
    phrase_rank = d_rank[d_begin[:-1]]
    last = np.append(np.flatnonzero(np.diff(p_string)) + 1, len(p_start))
    p_stop = np.repeat(last, np.diff(np.append(0, last)))
    parse_rank = suffix_ranks(phrase_rank[pid], p_stop)
    after = np.zeros(len(p_start), dtype=np.int64)
    after[:-1][same[:-1]] = parse_rank[1:][same[:-1]]
    # a position's order: rest of its phrase, then the parse that follows
    owner = np.searchsorted(p_start, np.arange(n), "right") - 1
    in_dict = d_begin[pid[owner]] + (np.arange(n) - p_start[owner])
    return np.lexsort((after[owner], d_rank[in_dict]))


def _count(rows, k):
    parts = [np.frombuffer(p, np.uint8) for p, _ in rows]
    weight = np.array([w for _, w in rows])
    begin = np.append(0, np.cumsum([len(p) for p in parts]))
    data = np.concatenate(parts)
    order = corpus_order(data, begin)
    row = np.repeat(np.arange(len(rows)), np.diff(begin))
    order = order[order + k <= begin[row[order] + 1]]          # positions where a window starts
    if len(order) == 0:
        return order, order
    view = np.lib.stride_tricks.sliding_window_view(data, k)
    same = np.zeros(len(order) + 1, dtype=bool)
    for a in range(1, len(order), 8192):
        b = min(a + 8192, len(order))
        same[a:b] = (view[order[a:b]] == view[order[a - 1:b - 1]]).all(axis=1)
    hit = same[:-1] | same[1:] | (weight[row[order]] > 1)
    at = order[hit]
    return row[at], at - begin[row[at]]


def byte_units(k: int = WINDOW_BYTES, m: int = MINIMISER_BYTES) -> Units:
    return Units("bytes", k, min(m, k), _scan, _pack, _count)


def _finish(key, text, spans, k, names):
    def run(batches):
        for batch in (part for whole in batches for part in bs.slices(whole, text)):
            data, offs = bs.text_column(batch.column(text))
            marks = batch.column(spans)
            gone = covered(marks, np.flatnonzero(np.asarray(marks.is_valid())), np.diff(offs), k)
            first = gone.copy()                       # first byte of a removed run; runs end with their document
            first[1:] &= ~gone[:-1]
            first[offs[:-1][offs[:-1] < len(gone)]] = gone[offs[:-1][offs[:-1] < len(gone)]]
            n_bytes = np.diff(offs)
            n_removed = np.diff(np.append(0, np.cumsum(gone))[offs])
            n_spans = np.diff(np.append(0, np.cumsum(first))[offs])
            left = data[~gone].tobytes()
            ends = np.append(0, np.cumsum(n_bytes - n_removed)).tolist()
            kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:])]
            keep = [c for c in batch.schema.names if c not in (key, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
                + [pa.array(kept, pa.binary())], [*keep, *names])
    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          k: int = WINDOW_BYTES, bucket_windows: int = 200_000) -> DataFrame:
    """All columns of `docs` plus n_bytes, n_removed, n_spans (maximal removed
    runs) and kept_bytes (binary: a cut may fall inside a character)."""
    key = unused("row_key", docs.columns)
    spans = unused("row_spans", docs.columns)
    names = []
    for c in ("n_bytes", "n_removed", "n_spans", "kept_bytes"):
        names.append(unused(c, docs.columns + names))
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col))
    found = (repeated_starts(keyed, key, text_col, byte_units(k), bucket_windows)
             .select(F.col("k").alias(key), F.col("spans").alias(spans)))
    schema = T.StructType(docs.schema.fields
                          + [T.StructField(n, T.LongType()) for n in names[:3]]
                          + [T.StructField(names[3], T.BinaryType())])
    return keyed.join(found, key, "left").mapInArrow(_finish(key, text_col, spans, k, names), schema)


def sha256_hex(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
