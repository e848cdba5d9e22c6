"""Vectorised scanning of UTF-8 text columns inside tasks (numpy over Arrow buffers).

A batch of documents is one byte array plus document offsets. Words are found
with a byte table, hashed with a prefix-sum polynomial hash (64 bits, wrapping),
so no Python object is made per word. Hashes select candidates or index
vocabularies; where a result must be exact the callers compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multiplier and its inverse mod 2**64 for the prefix-sum hash.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 512 << 10      # text scanned at once; a scan holds some 100 bytes for each

# [^\x20\x09-\x0D]+ : any byte but ASCII white space (bytes >= 0x80 belong to words)
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased: digits, a-z, non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER_BYTES = LOWER.tobytes()

_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (kept per worker, grown on demand)."""
    if "p" not in _pow or len(_pow["p"]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for k, b in (("p", BASE), ("i", BASE_INV)):
            a = np.full(m, b, dtype=np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every pair; equal ranges hash alike."""
    return hash_between(prefix_hash(values), start, end)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `hash_between` needs of `values`, to hash many kinds of ranges."""
    p, inv = powers(len(values) + 1)
    acc = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[:len(values)], out=acc[1:])
    return acc, inv


def hash_between(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    acc, inv = prefix
    return mix((acc[end] - acc[start]) * inv[start])


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    _, o = text_column(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte range of every word, and per document the
    index of its first word (one entry more than documents)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    cut = np.zeros(len(data) + 1, dtype=bool)   # a document starts here
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(data.astype(np.uint64) + np.uint64(1), start, end)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    if len(a) < w:
        return a[:0]
    have, cur = 1, a
    while have < w:
        step = min(have, w - have)
        cur = np.minimum(cur[:len(cur) - step], cur[step:])
        have += step
    return cur


def runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges first[i] .. last[i]-1."""
    n = last - first
    keep = n > 0
    first, n = first[keep], n[keep]
    if len(n) == 0:
        return np.zeros(0, np.int64)
    out = np.ones(n.sum(), dtype=np.int64)
    out[0] = first[0]
    at = np.cumsum(n)[:-1]
    out[at] = first[1:] - (first[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index into the sorted `keys` for each value, -1 where absent."""
    if len(keys) == 0:
        return np.full(len(values), -1, dtype=np.int64)
    i = np.searchsorted(keys, values)
    i[i == len(keys)] = 0
    return np.where(keys[i] == values, i, -1)
