"""Repeated fixed-length windows of a corpus, found through super-k-mers.

A unit is a word or a byte; a window is `k` consecutive units of one document.
Every window has a minimiser: the m-gram of units in it whose hash is least.
Equal windows have equal minimisers, so

1. each document is cut into runs of windows that share a minimiser, and the
   minimisers are counted over the corpus (combined before the shuffle);
2. a minimiser that occurs once cannot belong to a repeated window, so only runs
   of the others go on. Equal runs (128 bits of hash: minimiser and whole run) are
   merged with a weight. Where all runs of a minimiser are equal, all their windows
   repeat. Otherwise each distinct run travels once, as one packed string (its
   units), to the bucket of its minimiser;
3. a bucket with more than `bucket_windows` windows is dealt out again by whole
   windows, which Spark counts by their content; the other buckets are counted
   exactly inside tasks by the operator's own method;
4. the repeated window starts go back to every document that holds the string.

No step gathers a group in one task: counts are pre-aggregated, joins on a
minimiser or string can be split, and per-document lists are bounded by the
document. Texts are dealt out by key once; steps 2 and 4 read that exchange. A document is identified by a 64-bit hash of its id and text:
rows equal in both share their windows' fate, which is the same for both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpulse.llm import bytescan as bs
from stockpulse.llm.scratch import unused, written

POS_MASK = np.uint64(0xFFFFFF)


@dataclass(frozen=True)
class Units:
    """What a window consists of, and how a packed string is cut and counted."""
    name: str
    k: int                                  # units in a window
    m: int                                  # units in a minimiser
    scan: Callable                          # (data, offsets) -> (unit hashes, first unit of each document)
    pack: Callable                          # (text bytes) -> (packed bytes, unit starts, unit ends in it)
    count: Callable                         # ([(packed, weight)], k) -> (rows, windows) of repeated windows


def minimiser_runs(hashes: np.ndarray, first: np.ndarray, k: int, m: int):
    """Runs of windows with one minimiser: (document, first window within the
    document, windows, minimiser, hash of the run, occurrences of the minimiser in it)."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none, none, none
    at = np.arange(n - m + 1)
    prefix = bs.prefix_hash(hashes)
    grams = bs.hash_between(prefix, at, at + m)
    ends = np.repeat(first[1:], np.diff(first))[:n - k + 1]
    win = np.flatnonzero(np.arange(n - k + 1) + k <= ends)
    if len(win) == 0:
        return none, none, none, none, none, none
    low = bs.sliding_min((grams & ~POS_MASK) | (at.astype(np.uint64) & POS_MASK), k - m + 1)[win] & POS_MASK
    pos = win + ((low.astype(np.int64) - win) & int(POS_MASK))
    mini = grams[pos].view(np.int64)
    fresh = np.ones(len(win), dtype=bool)
    fresh[1:] = (mini[1:] != mini[:-1]) | (win[1:] != win[:-1] + 1)
    moved = np.ones(len(win), dtype=np.int64)
    moved[1:] = pos[1:] != pos[:-1]
    head = np.flatnonzero(fresh)
    occ = np.add.reduceat(np.maximum(moved, fresh), head)
    size = np.diff(np.append(head, len(win)))
    start = win[head]
    doc = np.searchsorted(first, start, "right") - 1
    whole = bs.hash_between(prefix, start, start + size + k - 1).view(np.int64)
    return doc, start - first[doc], size, mini[head], whole, occ


def _scan_runs(units: Units, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, text):
                doc, start, size, mini, whole, occ = minimiser_runs(
                    *units.scan(*bs.text_column(part.column(text))), units.k, units.m)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mini), pa.array(whole), pa.array(np.asarray(part.column(key))[doc]),
                         pa.array(start << 32 | size), pa.array(occ)], ["mini", "run", "k", "span", "n"])
    return run


def _fetch(units: Units, text: str, wanted: str):
    """The packed strings a document is to send: (mini, run, w) each, once."""
    def run(batches):
        for batch in batches:
            for part in bs.slices(batch, text):
                data, offs = bs.text_column(part.column(text))
                doc, start, size, mini, whole, _ = minimiser_runs(*units.scan(data, offs), units.k, units.m)
                lists = part.column(wanted)
                flat = lists.flatten()
                owner = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(np.asarray(lists.offsets)))
                want = _tags(owner, np.asarray(flat.field("mini")), np.asarray(flat.field("run")))
                order = np.argsort(want)
                have = _tags(doc, mini, whole)
                found = bs.lookup(want[order], have)
                pick = np.flatnonzero(found >= 0)
                pick = np.sort(pick[np.unique(have[pick], return_index=True)[1]])
                if not len(pick):
                    continue
                strings, now, raw = [], -1, data.tobytes()
                for d, s, n in zip(doc[pick].tolist(), start[pick].tolist(), size[pick].tolist()):
                    if d != now:
                        packed, begin, end = units.pack(raw[offs[d]:offs[d + 1]])
                        now = d
                    strings.append(packed[begin[s]:end[s + n + units.k - 2]])
                src = pa.array(order[found[pick]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini[pick]), pa.array(whole[pick]), pa.array(size[pick]), pa.array(strings, pa.binary()),
                     flat.field("w").take(src)], ["mini", "run", "n", "packed", "w"])
    return run


def _tags(doc: np.ndarray, mini: np.ndarray, whole: np.ndarray) -> np.ndarray:
    tag = np.uint64(bs.BASE)
    return bs.mix(bs.mix(mini.view(np.uint64) ^ (doc.astype(np.uint64) * tag)) + whole.view(np.uint64))


def _windows(units: Units):
    """Whole windows of the strings of hot buckets, equal ones of a string once."""
    def run(batches):
        for batch in batches:
            rows = []
            for mini, whole, p, w in zip(*(batch.column(c).to_pylist() for c in ("mini", "run", "packed", "w"))):
                packed, begin, end = units.pack(p)
                seen: dict[bytes, list[int]] = {}
                for j in range(len(begin) - units.k + 1):
                    seen.setdefault(packed[begin[j]:end[j + units.k - 1]], []).append(j)
                rows += [(mini, whole, js, [j + 1 for j in js], hashlib.md5(s).digest(), w * len(js)) for s, js in seen.items()]
                if len(rows) > 20_000:
                    yield _win_batch(rows)
                    rows = []
            if rows:
                yield _win_batch(rows)
    return run


def _win_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      ["mini", "run", "lo", "hi", "win", "w"])


def _count_buckets(units: Units, chunk_windows: int):
    """Rows arrive sorted by minimiser; whole minimisers are gathered to chunks
    of bounded size (a bucket over the bound does not come here)."""
    def solve(rows):
        r, j = units.count([(p, w) for _, _, p, w in rows], units.k)
        if not len(r):
            return
        order = np.lexsort((j, r))
        r, j = r[order], j[order]
        head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (j[1:] != j[:-1] + 1)))     # of a range of windows
        lo, hi, of = j[head], j[np.append(head[1:], len(j)) - 1] + 1, r[head]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))                              # of a row's ranges
        offs = pa.array(np.append(cut, len(of)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in of[cut]], pa.int64()), pa.array([rows[i][1] for i in of[cut]], pa.int64()),
             pa.ListArray.from_arrays(offs, pa.array(lo, pa.int32())), pa.ListArray.from_arrays(offs, pa.array(hi, pa.int32()))],
            ["mini", "run", "lo", "hi"])

    def run(batches):
        rows, total, last = [], 0, None
        for batch in batches:
            for mini, whole, n, packed, w in zip(*(batch.column(c).to_pylist() for c in ("mini", "run", "n", "packed", "w"))):
                if total >= chunk_windows and mini != last:
                    yield from solve(rows)
                    rows, total = [], 0
                rows.append((mini, whole, packed, w))
                total += n
                last = mini
        if rows:
            yield from solve(rows)
    return run


def repeated_starts(docs: DataFrame, key: str, text: str, units: Units,
                    bucket_windows: int = 50_000) -> DataFrame:
    """docs + `key` (a 64-bit id of the row) -> (k, spans): for every document
    with repeated windows, a list of (start, lo, hi): the windows that begin at
    start + lo[i] up to start + hi[i] - 1 repeat."""
    runs = written(docs.select(key, text).mapInArrow(
        _scan_runs(units, key, text), "mini long, run long, k long, span long, n long"), f"{units.name}-runs")
    often = runs.groupBy("mini").agg(F.sum("n").alias("c")).filter("c > 1").select("mini")
    found = written(runs.select("mini", "run", "k", "span").join(often, "mini"), f"{units.name}-often")
    # distinct strings, with one document that holds each
    n = F.col("span").bitwiseAND(0xFFFFFFFF)
    distinct = found.groupBy("mini", "run").agg(F.count("*").alias("w"), F.min("k").alias("k"), F.min(n).alias("n"))
    size = distinct.groupBy("mini").agg(F.count("*").alias("strings"), F.sum("w").alias("places"), F.sum("n").alias("size"))
    known = distinct.join(size, "mini")
    # a minimiser whose runs are all the same string: every window of it repeats
    alike = known.filter("strings = 1 and places > 1") \
        .select("mini", "run", F.array(F.lit(0)).alias("lo"), F.array(F.col("n").cast("int")).alias("hi"))
    # otherwise the strings differ (or a lone one may repeat inside itself): each is sent once
    wanted = unused("wanted", docs.columns)
    differ = known.filter("strings > 1 or places = 1")

    def sent(rows):
        lists = (rows.groupBy("k").agg(F.collect_list(F.struct("mini", "run", "w")).alias(wanted))
                 .withColumnRenamed("k", key))
        return docs.join(lists, key).mapInArrow(_fetch(units, text, wanted),
                                                "mini long, run long, n long, packed binary, w long")

    light = (sent(differ.filter(F.col("size") <= bucket_windows)).repartition("mini").sortWithinPartitions("mini")
             .mapInArrow(_count_buckets(units, bucket_windows), "mini long, run long, lo array<int>, hi array<int>"))
    wins = sent(differ.filter(F.col("size") > bucket_windows)).mapInArrow(
        _windows(units), "mini long, run long, lo array<int>, hi array<int>, win binary, w long")
    twice = wins.groupBy("win").agg(F.sum("w").alias("c")).filter("c > 1").select("win")
    heavy = wins.join(twice, "win").select("mini", "run", "lo", "hi")
    hits = alike.unionByName(light).unionByName(heavy)
    return (found.join(hits, ["mini", "run"])
            .select("k", F.struct(F.shiftright("span", 32).alias("start"), "lo", "hi").alias("s"))
            .groupBy("k").agg(F.collect_list("s").alias("spans")))


def covered(spans: pa.Array, rows: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
    """Mask of the units of several documents (units[d] each, one after the
    other) that lie in a repeated window. spans: one list per document; rows: the
    documents that have one."""
    begin = np.append(0, np.cumsum(units))
    step = np.zeros(int(begin[-1]) + 1, dtype=np.int32)
    if len(rows):
        lists = spans.take(pa.array(rows))
        flat = lists.flatten()
        owner = np.repeat(rows, np.diff(np.asarray(lists.offsets)))
        lo, hi = flat.field("lo"), flat.field("hi")
        at = np.repeat(begin[owner] + np.asarray(flat.field("start")), np.diff(np.asarray(lo.offsets)))
        np.add.at(step, at + np.asarray(lo.flatten()), 1)
        np.add.at(step, at + np.asarray(hi.flatten()) - 1 + k, -1)
    return np.cumsum(step[:-1]) > 0
