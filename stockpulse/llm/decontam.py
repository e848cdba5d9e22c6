"""Benchmark decontamination with an FM-index per training shard.

Words are runs of digits, a-z and non-ASCII after A-Z are lower-cased. The test
phrases are all windows of `k` words of the benchmark items (a shorter item is one
phrase). A task gathers documents to shards of about `shard_words` candidate
words, encodes them over the phrases' vocabulary (any other word is a separator, so runs
without enough vocabulary words in a row cannot hold a phrase and are left out)
and builds an FM-index: suffix array, Burrows-Wheeler transform, a wavelet matrix
for ranks, and every `SAMPLE`-th text position of the suffix array. All phrases
are searched backwards at once; occurrences are located by walking to a sampled
position, and their word spans are merged per document. No shuffle is needed: a
document's result depends on the document and the phrases only.

The phrases are sent to all tasks. They are taken in blocks of at most
`block_bytes` of benchmark text, so what is sent is bounded however large the
benchmark is; each further block is one more pass over the documents.

Defined results: null, empty and wordless texts have no words and no hits; null
or wordless items have no phrases; repeated items, and items of one id, count
once in n_items; an item with a null id counts as the empty id; repeated documents
are judged alike; an empty benchmark marks nothing, empty documents stay empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.scratch import unused

PHRASE_WORDS = 13
SHARD_WORDS = 1 << 18
SHARD_SLICES = 64           # slices of text (0.5 MB each) in a shard at most
SAMPLE = 16
BLOCK_BYTES = 8 << 20
CONTAMINATED_SHARE = 20      # n_hit * 20 >= n_words


class Wavelet:
    """Wavelet matrix over small integers: rank of a symbol before a position."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            ones = np.append(0, np.cumsum(bit)).astype(np.int32)
            self.levels.append((ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at
        for i, (ones, zeros) in enumerate(self.levels):
            one = ((sym >> (self.bits - 1 - i)) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(one, zeros + lo1, lo - lo1)
            hi = np.where(one, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Index of an integer sequence; symbol 0 is a separator and never searched."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        seq = np.append(seq, 0).astype(np.int64)       # a last separator closes the text
        n = len(seq)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.start = np.append(0, np.cumsum(np.bincount(seq, minlength=sigma)))
        self.tree = Wavelet(self.bwt, max(1, int(sigma - 1).bit_length()))
        self.sampled = sa % SAMPLE == 0
        self.sampled |= self.bwt == 0                  # a walk never has to pass a separator
        self.sample_at = np.append(0, np.cumsum(self.sampled))
        self.samples = sa[self.sampled]
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array range of each phrase (rows of `phrases`, left-aligned)."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (lo < hi))
            sym = phrases[live, lengths[live] - 1 - step]
            lo[live] = self.start[sym] + self.tree.rank(sym, lo[live])
            hi[live] = self.start[sym] + self.tree.rank(sym, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of suffix-array rows."""
        out = np.zeros(len(rows), dtype=np.int64)
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.sampled[rows[todo]]
            done = todo[here]
            out[done] = self.samples[self.sample_at[rows[done]]] + steps[done]
            todo = todo[~here]
            sym = self.bwt[rows[todo]]
            rows[todo] = self.start[sym] + self.tree.rank(sym, rows[todo])
            steps[todo] += 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling. Separators are told apart by position, so that no
    comparison runs past one."""
    n = len(seq)
    zero = seq == 0
    rank = seq + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    step = 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:n - step] = rank[step:] + 1
        order = np.argsort(rank * (int(rank.max()) + 2) + nxt, kind="stable")
        key = (rank * (int(rank.max()) + 2) + nxt)[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.append(0, np.cumsum(key[1:] != key[:-1]))
        if int(new.max()) == n - 1 or step >= n:
            return order
        rank = new
        step *= 2


class Phrases:
    """Vocabulary and distinct phrases of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], k: int) -> None:
        vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            data = np.frombuffer(text, np.uint8)
            data = bs.LOWER[data]
            start, end, _ = bs.words(data, np.array([0, len(data)]), bs.ALNUM)
            raw = data.tobytes()
            ids = [vocab.setdefault(raw[a:b], len(vocab) + 1) for a, b in zip(start.tolist(), end.tolist())]
            for i in range(max(1, len(ids) - k + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + k]), set()).add(item)
        self.vocab, self.sigma = vocab, len(vocab) + 1
        self.length = np.array([len(p) for p in found], dtype=np.int64)
        self.table = np.zeros((len(found), k), dtype=np.int64)
        for i, p in enumerate(found):
            self.table[i, :len(p)] = p
        names = sorted({x for s in found.values() for x in s})
        number = {x: i for i, x in enumerate(names)}
        self.names, self.items = names, [[number[x] for x in s] for s in found.values()]
        joined = b" ".join(vocab)
        ends = np.cumsum([len(w) + 1 for w in vocab]) - 1 if vocab else np.zeros(0, np.int64)
        begins = np.append(0, ends[:-1] + 1) if vocab else ends
        hashes = bs.word_hashes(np.frombuffer(joined, np.uint8), begins, ends) if vocab else np.zeros(0, np.uint64)
        self.hashes = np.sort(hashes)


def _shard_hits(seq: list[np.ndarray], p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, phrase) of all occurrences in the concatenated shard."""
    index = FMIndex(np.concatenate(seq), p.sigma)
    lo, hi = index.search(p.table, p.length)
    rows = bs.runs(lo, hi)
    which = np.repeat(np.arange(len(lo)), np.maximum(hi - lo, 0))
    return index.locate(rows), p.length[which], which


def _scan(phrases, id_cols: list[str], text: str, names: list[str], shard_words: int):
    def run(batches):
        p = phrases.value
        least = int(p.length.min()) if len(p.length) else None
        parts, docs, size = [], [], 0          # shard under construction

        def flush():
            # docs: (batch columns, words per document, [(row, first word, shard position, run length)])
            hit_runs = []
            if size:
                pos, length, which = _shard_hits(parts, p)
                order = np.argsort(pos, kind="stable")
                hit_runs = (pos[order], length[order], which[order])
            for cols, n_words, seg in docs:
                n_hit = np.zeros(len(n_words), dtype=np.int64)
                items: list[set] = [set() for _ in n_words]
                spans: list[list] = [[] for _ in n_words]
                for row, first, at, run_len in seg:
                    a, b = np.searchsorted(hit_runs[0], [at, at + run_len])
                    if a == b:
                        continue
                    s = hit_runs[0][a:b] - at + first
                    e = s + hit_runs[1][a:b]
                    for w in set(hit_runs[2][a:b].tolist()):
                        items[row].update(p.items[w])
                    spans[row] += merged(s, e)
                for row, sp in enumerate(spans):
                    n_hit[row] = sum(b - a for a, b in sp)
                yield pa.RecordBatch.from_arrays(
                    cols + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                            pa.array([sorted(p.names[i] for i in s) for s in items], pa.list_(pa.string())),
                            pa.array([[{"start": a, "end": b} for a, b in sp] for sp in spans], SPAN_ARROW)],
                    [*id_cols, *names])

        for batch in batches:
            for part in bs.slices(batch, text):
                data, offs = bs.text_column(part.column(text))
                data = bs.LOWER[data]
                start, end, first = bs.words(data, offs, bs.ALNUM)
                seg = []
                if least is not None and len(start):
                    inside = bs.lookup(p.hashes, bs.word_hashes(data, start, end)) >= 0
                    cut = np.zeros(len(start) + 1, dtype=bool)
                    cut[first] = True
                    head = inside.copy()
                    head[1:] &= ~inside[:-1] | cut[1:-1]
                    tail = inside.copy()
                    tail[:-1] &= ~inside[1:] | cut[1:-1]
                    a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
                    long = b - a >= least
                    a, b = a[long], b[long]
                    row = np.searchsorted(first, a, "right") - 1
                    raw = data.tobytes()
                    for r, x, y in zip(row.tolist(), a.tolist(), b.tolist()):
                        ids = np.array([p.vocab.get(raw[s:e], 0) for s, e in zip(start[x:y].tolist(), end[x:y].tolist())]
                                       + [0], dtype=np.int64)
                        seg.append((r, x - int(first[r]), size, y - x))
                        parts.append(ids)
                        size += len(ids)
                docs.append(([part.column(c) for c in id_cols], np.diff(first), seg))
                if size >= shard_words or len(docs) >= SHARD_SLICES:
                    yield from flush()
                    parts, docs, size = [], [], 0
        if docs:
            yield from flush()
    return run


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of the ranges, sorted (start ascending)."""
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    top = np.maximum.accumulate(end)
    fresh = np.append(True, start[1:] > top[:-1])
    heads = np.flatnonzero(fresh)
    return list(zip(start[heads].tolist(), top[np.append(heads[1:] - 1, len(end) - 1)].tolist()))


SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", k: int = PHRASE_WORDS,
                       keep: list[str] | None = None, shard_words: int = SHARD_WORDS,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of docs (all by default) plus n_words, n_hit, items (ids
    of the items with an occurring phrase, as sorted strings), spans (merged
    ranges of hit words) and contaminated. New names get underscores on a clash."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = []
    for c in ("n_words", "n_hit", "items", "spans", "contaminated"):
        names.append(unused(c, docs.columns + names))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                             F.col(item_text).alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
        T.StructField(names[2], T.ArrayType(T.StringType())), T.StructField(names[3], SPAN)])
    hits, carried = docs, keep
    for b in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        phrases = spark.sparkContext.broadcast(Phrases([(r["i"], r["t"].encode()) for r in mine.toLocalIterator()], k))
        if b == 0:
            cols = keep if blocks == 1 or text_col in keep else [*keep, text_col]
            schema0 = T.StructType([docs.schema[c] for c in cols] + list(schema.fields[-4:]))
            hits = docs.select(*dict.fromkeys([*cols, text_col])).mapInArrow(
                _scan(phrases, cols, text_col, names[:4], shard_words), schema0)
            carried = cols
        else:
            again = [unused(n + "_block", carried + names) for n in names[:4]]
            schema1 = T.StructType(list(hits.schema.fields)
                                   + [T.StructField(n, f.dataType) for n, f in zip(again, schema.fields[-4:])])
            more = hits.mapInArrow(_scan(phrases, hits.columns, text_col, again, shard_words), schema1)
            union = F.array_sort(F.concat(names[3], again[3]))
            hits = more.select(*carried, names[0],
                               F.col(names[1]),
                               F.array_sort(F.array_union(names[2], again[2])).alias(names[2]),
                               _merge_spans(union).alias(names[3]))
    if blocks > 1:
        hits = hits.withColumn(names[1], F.aggregate(names[3], F.lit(0).cast("long"),
                                                     lambda acc, s: acc + s["end"] - s["start"]))
    return hits.select(*keep, *names[:4],
                       ((F.col(names[1]) > 0) & (CONTAMINATED_SHARE * F.col(names[1]) >= F.col(names[0])))
                       .alias(names[4]))


def _merge_spans(sorted_spans):
    """Union of sorted ranges with built-in functions."""
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        sorted_spans, F.array().cast(SPAN),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= last(acc)["end"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(last(acc)["start"].alias("start"),
                                                        F.greatest(last(acc)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
