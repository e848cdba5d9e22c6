"""SimHash near-dedup with BK-trees.

Fingerprints: texts with A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of
`n` words with repeats; a bit is set if it is set in over half of the shingles'
XXH64 (seed 42). Two documents link if their fingerprints differ in `radius` bits
at most; the classes are the connected components.

Equal fingerprints are merged first, so a group of copies is one node. The 64
bits are cut into blocks; fingerprints within the radius agree on all but
`radius` blocks, so every combination of the other blocks is a shard key and no
link is lost. Inside a shard the fingerprints form BK-trees: children are keyed by
the integer Hamming distance to their parent, and a query follows only the edges
within the radius of its own distance. A shard over `tree_size` is dealt out anew
with more blocks (longer keys); what is still over it there is split into several
trees, each of which is sent to all queries of the shard. A task returns a
spanning forest of its links, never all pairs.

The trees of a shard go to that shard's queries only, by the shuffle: a broadcast
of all trees to all tasks would grow with the corpus.

Defined results: null and empty texts have no words and the fingerprint zero,
which links like any other; fewer than `n` words are one shingle; repeated rows
link at distance zero; null ids are kept and a class of null ids only has the id
null; an empty table stays empty.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm import bytescan as bs
from stockpulse.llm.components import Forest, connected_components
from stockpulse.llm.scratch import unused, written

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TREE_SIZE = 1024
BATCH_SHINGLES = 100_000


def shingle_hashes(text: bytes, n: int = SHINGLE_WORDS) -> list[int]:
    ws = text.translate(bs.LOWER_BYTES).split()
    h = xxhash.xxh64_intdigest
    if len(ws) <= n:
        return [h(b" ".join(ws), SEED)] if ws else []
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    begins = np.append(0, ends[:-1]).tolist()
    return [h(joined[a:b], SEED) for a, b in zip(begins, (ends[n - 1:] - 1).tolist())]


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive groups of hashes (group sizes in counts)."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some) == 0:
        return out
    at = np.append(0, np.cumsum(counts[some])[:-1])
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    major = (2 * ones > counts[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _fingerprint_rows(text: str, fp: str, n: int):
    def run(batches):
        for batch in batches:
            keep = [c for c in batch.schema.names if c != text]
            for part in bs.slices(batch, text):
                got, hashes, counts = [], [], []
                whole = []
                for t in part.column(text).to_pylist():
                    hs = shingle_hashes(t.encode(), n) if t else []
                    hashes += hs
                    counts.append(len(hs))
                    if len(hashes) > BATCH_SHINGLES:
                        got.append(fingerprints(np.array(hashes, dtype=np.uint64), np.array(counts)))
                        hashes, counts = [], []
                got.append(fingerprints(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64)))
                whole = np.concatenate(got).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(whole)], [*keep, fp])
    return run


def with_fingerprint(docs: DataFrame, text_col: str, fp: str, n: int = SHINGLE_WORDS,
                     keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the text) and the fingerprint as a long."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(fp, T.LongType())])
    return docs.select(*keep, text_col).mapInArrow(_fingerprint_rows(text_col, fp, n), schema)


class BKTree:
    """Nodes are [value, {distance: child}]."""

    def __init__(self, values) -> None:
        self.root = None
        for v in values:
            self.add(v)

    def add(self, v: int) -> None:
        if self.root is None:
            self.root = [v, {}]
            return
        node = self.root
        while True:
            d = (v ^ node[0]).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [v, {}]
                return
            node = child

    def within(self, q: int, radius: int) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (q ^ value).bit_count()
            if d <= radius:
                out.append(value)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return out


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """All keys of a fingerprint: a combination's number and the bits of its blocks."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for i, keep in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cut[b + 1]) - (1 << cut[b])) for b in keep)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(i).alias("combo"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.explode(F.array(*keys))


def _tree_links(radius: int):
    """Rows sorted by (shard, tree), the tree's own members first."""
    def run(batches):
        shard, tree, forest = None, None, Forest()
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("combo", "bits", "t", "own", "fp")]
            for combo, bits, t, own, fp in zip(*cols):
                if (combo, bits, t) != shard:
                    shard, tree = (combo, bits, t), BKTree(())
                fp &= 0xFFFFFFFFFFFFFFFF
                for other in tree.within(fp, radius):
                    if other != fp:
                        forest.join(other, fp)
                if own:
                    tree.add(fp)
            if len(forest.up) > 200_000:
                yield _edges(forest)
                forest = Forest()
        yield _edges(forest)
    return run


def _edges(forest: Forest) -> pa.RecordBatch:
    e = np.array(forest.edges(), dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def links(nodes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE,
          levels: tuple[int, ...] = (4, 6)) -> DataFrame:
    """nodes (fp long, distinct) -> (u, v): edges that connect exactly the
    fingerprints connected by pairs within the radius."""
    out, rest = None, nodes
    for level in levels:
        last = level == levels[-1]
        keyed = rest.select("fp", shard_keys(F.col("fp"), max(level, radius + 1), radius).alias("s")).select("s.*", "fp")
        size = keyed.groupBy("combo", "bits").agg(F.count("*").alias("c")).filter("c > 1")
        sized = keyed.join(size, ["combo", "bits"])
        here = sized if last else sized.filter(F.col("c") <= tree_size)
        trees = F.ceil(F.col("c") / F.lit(tree_size)).cast("int")
        dealt = here.select("combo", "bits", "fp", F.pmod(F.xxhash64("fp"), trees).cast("int").alias("mine"),
                            F.explode(F.sequence(F.lit(0), trees - 1)).alias("t")) if last else \
            here.select("combo", "bits", "fp", F.lit(0).alias("mine"), F.lit(0).alias("t"))
        found = (dealt.select("combo", "bits", "t", (F.col("mine") == F.col("t")).alias("own"), "fp")
                 .repartition("combo", "bits", "t").sortWithinPartitions("combo", "bits", "t", F.desc("own"))
                 .mapInArrow(_tree_links(radius), "u long, v long"))
        out = found if out is None else out.unionByName(found)
        if not last:
            rest = sized.filter(F.col("c") > tree_size).select("fp").distinct()
    return out


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): one row per document; component is the smallest id
    in its class. Names as given: id_col, `fp`, `component`."""
    rows = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                    "text", "fp", shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-nodes")
    comp = connected_components(links(nodes.select("fp"), radius))
    rooted = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    label = rooted.select("fp", "root").join(best, "root").select("fp", "component")
    return rows.join(label, "fp").select("id", "fp", "component")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each class, with its columns as they are: the one with the
    smallest id (a null id last), of several rows with that id the one whose text
    hash is least; of identical rows one stays."""
    rows = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
                                                F.col(text_col).alias("text")), "text", "fp", shingle), "fingerprints")
    copies = rows.groupBy("fp", "id", "h").agg(F.count("*").alias("c"))
    nodes = written(copies.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h", "c"))
                                             .alias("least")), "fingerprint-nodes")
    return keep_least(docs, nodes, connected_components(links(nodes.select("fp"), radius)), id_col, text_col)


def keep_least(docs: DataFrame, nodes: DataFrame, comp: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nodes (fp, least: struct of n, id, h, c), comp (node, root): the documents
    that `keep_one_per_class` keeps."""
    fp, h = unused("fp", docs.columns), unused("h", docs.columns)
    c = unused("c", docs.columns)
    best = (nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
            .select(F.col("least.id").alias(fp), F.col("least.h").alias(h), F.col("least.c").alias(c)))
    row_h = unused("row_h", docs.columns)
    keyed = docs.withColumn(row_h, F.xxhash64(text_col))
    stays = keyed.join(best, keyed[id_col].eqNullSafe(best[fp]) & (keyed[row_h] == best[h]))
    single = stays.filter(F.col(c) == 1).select(*docs.columns)
    # identical (id, text) rows are rare; of those one stays
    others = [x for x in docs.columns if x != id_col]
    many = (stays.filter(F.col(c) > 1).groupBy(id_col, row_h)
            .agg(F.first(F.struct(*others)).alias(row_h + "_one"))
            .select(id_col, row_h + "_one.*").select(*docs.columns))
    return single.unionByName(many)
