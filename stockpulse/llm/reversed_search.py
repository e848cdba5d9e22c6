"""Ranked lexical search turned round: the queries are indexed and the documents stream by.

The items' terms form an inverted index (term -> items), which is broadcast. Every
document's term counts run through it: a term that the index knows adds its weighted,
length-normalised frequency to the items that hold it. A task keeps a heap of the k
best documents per item and emits only those; a window merges the tasks' heaps.

Two scans of the documents: one for the corpus statistics (documents, terms, document
frequencies of the index's terms), one for the scores. Nothing of the documents is
shuffled but the heaps (tasks x items x k rows). The index is built for `block_bytes` of
item text at a time, which bounds the broadcast; more items mean more pairs of scans.

Terms are the maximal runs of digits, A-Z, a-z and bytes above 0x7F, A-Z lower-cased.
All scores are integers, as the score functions below state.

Defined results: null and empty texts have no term and never rank; an item without
a term, or whose terms no document holds, has no row; equal (id, text) rows of the items
are one item, rows of one id with other texts are items of their own under that id; repeated
documents rank each for itself; equal scores go by ascending id, a null id last; empty
tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import tokens
from stockpulse.llm.scratch import written

TOP = 10
BLOCK_BYTES = 4 << 20      # item text indexed at once
CELLS = 1 << 21            # document x item scores held at once
SLICE_TERMS = 500_000
LENGTH_SHARE = 90          # percent of the length normalisation

TERM_TABLE = tokens.table(bytes(c for c in range(0x80)
                                if not (0x30 <= c < 0x3A or 0x41 <= c < 0x5B or 0x61 <= c < 0x7B)))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a slice of the text at a time."""
    if text:
        for part in tokens.parts(text.encode("utf-8", "surrogatepass").translate(TERM_TABLE)):
            yield part.split()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def length_norm(n: int, docs: int, all_terms: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // all_terms


def gain(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score that terms of weight w with frequency tf add in documents of norm m."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class ItemIndex:
    """term -> number, and number -> the items that hold it (runs of one array)."""

    def __init__(self, texts: list[str | None]) -> None:
        held: dict[bytes, list[int]] = {}
        for i, text in enumerate(texts):
            for term in set().union(*map(set, terms(text))):
                held.setdefault(term, []).append(i)
        self.number = {t: j for j, t in enumerate(held)}
        self.items = len(texts)
        self.holders = np.array([i for v in held.values() for i in v], dtype=np.int64)
        self.first = np.append(0, np.cumsum([len(v) for v in held.values()], dtype=np.int64)).astype(np.int64)
        self.weight = np.zeros(len(held), dtype=np.int64)
        self.docs = self.terms = 0

    def learn(self, docs: int, all_terms: int, df: dict[int, int]) -> None:
        self.docs, self.terms = docs, all_terms
        for j in range(len(self.weight)):
            self.weight[j] = weight(docs, df.get(j, 0))


class Heaps:
    """The k best (score, id) per item. Rows are kept sorted; score 0 is an empty place."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.score = np.zeros((items, k), dtype=np.int64)
        self.id = np.zeros((items, k), dtype=np.int64)
        self.none = np.zeros((items, k), dtype=bool)     # the id is null

    def update(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """scores: documents x items. Documents that reach an item's least score compete with its heap."""
        d, i = np.nonzero(scores >= np.maximum(self.score[:, -1], 1))
        if not len(d):
            return
        touched = np.unique(i)
        old = np.repeat(touched, self.k)
        item = np.concatenate([old, i])
        score = np.concatenate([self.score[touched].ravel(), scores[d, i]])
        num = np.concatenate([self.id[touched].ravel(), ids[d]])
        null = np.concatenate([self.none[touched].ravel(), none[d]])
        order = np.lexsort((num, null, -score, item))
        heads = np.searchsorted(item[order], touched)
        best = order[heads[:, None] + np.arange(self.k)]     # every item has k rows at least: its old ones
        self.score[touched], self.id[touched], self.none[touched] = score[best], num[best], null[best]

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score)
        return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(self.score[i, j]),
                                           pa.array(self.id[i, j], mask=self.none[i, j])], ["n", "score", "id"])


def _counted(batches, index: ItemIndex, size: int):
    """(ids, null ids, terms per document, document, term, tf) of up to `size` documents."""
    ids, none, n, doc, term, held = [], [], [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count = 0
            for part in terms(text):
                count += len(part)
                hit = [j for j in map(index.number.get, part) if j is not None]
                if hit:
                    j, tf = np.unique(np.array(hit, dtype=np.int64), return_counts=True)
                    doc.append(np.full(len(j), len(n)))
                    term.append(np.stack([j, tf]))
                    held += len(j)
            ids.append(0 if doc_id is None else doc_id)
            none.append(doc_id is None)
            n.append(count)
            if len(n) >= size or held >= SLICE_TERMS:
                yield _packed(ids, none, n, doc, term)
                ids, none, n, doc, term, held = [], [], [], [], [], 0
    if n:
        yield _packed(ids, none, n, doc, term)


def _packed(ids, none, n, doc, term):
    d = np.concatenate(doc) if doc else np.zeros(0, np.int64)
    t = np.concatenate(term, axis=1) if term else np.zeros((2, 0), np.int64)
    # a long document's slices may repeat a term
    width = int(t[0].max(initial=0)) + 1
    key, inv = np.unique(d * width + t[0], return_inverse=True)
    tf = np.bincount(inv, weights=t[1], minlength=len(key)).astype(np.int64)
    return np.array(ids, np.int64), np.array(none, bool), n, key // width, key % width, tf


def _statistics(shared):
    """(t, c): documents holding term t; t = -1: documents with a term, t = -2: all terms."""
    def run(batches):
        index = shared.value
        docs = total = 0
        df = np.zeros(len(index.weight), dtype=np.int64)
        for _, _, n, _, term, _ in _counted(batches, index, 4096):
            docs += sum(1 for x in n if x)
            total += sum(n)
            df += np.bincount(term, minlength=len(df))
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], t).astype(np.int64)),
                                          pa.array(np.append([docs, total], df[t]).astype(np.int64))], ["t", "c"])
    return run


def _heaps(shared, k: int):
    def run(batches):
        index = shared.value
        top = Heaps(index.items, k)
        size = max(1, min(4096, CELLS // max(index.items, 1)))
        for ids, none, n, doc, term, tf in _counted(batches, index, size):
            if not len(doc):
                continue
            m = np.array([length_norm(x, index.docs, index.terms) for x in n], dtype=np.int64)
            g = gain(index.weight[term], tf, m[doc])
            scores = np.zeros(len(n) * index.items, dtype=np.int64)
            per = index.first[term + 1] - index.first[term]
            # postings of some (document, term) pairs at a time
            cuts = np.searchsorted(np.cumsum(per), np.arange(CELLS, per.sum() + CELLS, CELLS))
            for a, b in zip(np.append(0, cuts[:-1] + 1), cuts + 1):
                c = per[a:b]
                at = np.repeat(index.first[term[a:b]] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
                np.add.at(scores, np.repeat(doc[a:b] * index.items, c) + index.holders[at], np.repeat(g[a:b], c))
            top.update(scores.reshape(len(n), index.items), ids, none)
        yield top.rows()
    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): per item its k best documents with a score above 0. `item` has
    the type of item_col; ids are long."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct()
    total = wanted.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    item_type = items.schema[item_col].dataType
    best = Window.partitionBy("n").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = None
    for b in range(blocks):
        mine = [(r["item"], r["text"]) for r in
                wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toLocalIterator()]
        index = ItemIndex([t for _, t in mine])
        first = spark.sparkContext.broadcast(index)
        seen = dict(rows.mapInArrow(_statistics(first), "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
                    .toPandas().itertuples(index=False))
        first.unpersist()
        index.learn(seen.pop(-1, 0), seen.pop(-2, 0), seen)
        shared = spark.sparkContext.broadcast(index)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(mine)],
                                      T.StructType([T.StructField("n", T.IntegerType()), T.StructField("item", item_type)]))
        found = (rows.mapInArrow(_heaps(shared, k), "n int, score long, id long")
                 .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .join(names, "n").select("item", "rank", "id", "score"))
        found = written(found, "ranked") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
