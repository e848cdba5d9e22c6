"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are merged first (a group of copies is one node with a weight). A
bounded sample fits cluster centres; centres within the threshold of each other form
one shard, so that no dense group is cut apart, and every node belongs to its
`overlap` nearest shards. A shard over SPLIT_PARTS times `shard_size` fits centres of its own from a
bounded sample and hands its nodes on to its `SUB_OVERLAP` nearest sub-shards, level
by level, so that shards do not grow with the table. In each shard a task builds a robust-pruned proximity
graph; the adjacency lists of a node from its shards are united. Every node then
searches its shards over the united graph: a greedy beam search from the shard's
medoid, followed by range expansion: from the node itself and from all nodes found
within the range, until no new node is in range. Similarities are computed in double
precision from the vectors, so no pair below the threshold is ever linked.

A pair that shares several shards is counted in the smallest of them only, so link
counts need no pair table; for the components a task returns a spanning forest of
its links. A shard over `shard_size` that stays whole (a dense group, whose links are
as many) is split by hash, and all its nodes search every part.

Recall is audited each time: nodes drawn at random, and nodes drawn from those with
links, are compared with all others in blocks. A draw's recall is the mean over its
nodes that have links of the share found, counted in different vectors, so neither
nodes without links nor large groups of copies hide a loss; the lower of the two
draws counts. While it is under `min_recall` the graph is built anew with twice the
overlap and beam; after `ATTEMPTS` builds RecallError is raised, so no result under
`min_recall` is ever returned. Without any link in the draws recall is null.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link; repeated rows
and rows of one id are vectors of their own; ids may be null; an empty table stays empty.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpulse.llm import bytescan as bs
from stockpulse.llm.components import connected_components
from stockpulse.llm.scratch import written

log = logging.getLogger(__name__)

THRESHOLD = 0.9
SHARD_SIZE = 2048        # nodes in a shard's part
OVERLAP = 4              # shards of a node
DEGREE = 24              # out-edges kept by the pruning
CANDIDATES = 64          # nearest nodes considered for a node's edges
FAR_EDGES = 16           # seeded other nodes considered too, so the graph stays navigable
ALPHA = 1.2
BEAM = 16
SLACK = 0.05             # nodes this far below the threshold are still expanded
CENTRE_SAMPLE = 16_384   # vectors the centres are fitted on
SAMPLE_BYTES = 1 << 27   # and at most this many bytes of them
MAX_CENTRES = 1024       # of one level
SUB_OVERLAP = 2          # sub-shards of a node of a shard that is split
SPLIT_PARTS = 4          # shards of more parts are split by centres of their own
SUB_SAMPLE = 8           # sampled vectors per centre of a split shard
CHUNK = 65_536           # nodes of a split shard that one task assigns
LEVELS = 3               # of splitting
AUDIT_QUERIES = 512      # nodes of each of the audit's two draws
ATTEMPTS = 4
MIN_RECALL = 0.9
SEED = 1


class RecallError(RuntimeError):
    """The audited recall stayed under the demanded one."""


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision (scaled first, so no overflow)."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(col) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def prune(sim: np.ndarray, medoid: int, rng) -> np.ndarray:
    """Robust pruning of every node's candidates -> neighbours (n, 2 * DEGREE), -1 padded."""
    n = len(sim)
    near = min(CANDIDATES + 1, n)
    cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    far = rng.integers(0, n, size=(n, min(FAR_EDGES, n)))
    cand = np.hstack([cand, far, np.full((n, 1), medoid)])
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-sim[rows, cand], axis=1, kind="stable"), axis=1)
    dist = 1 - sim[rows, cand]
    alive = cand != rows
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    for r in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[np.arange(n), first]
        if not some.any():
            break
        p = cand[np.arange(n), first]
        out[some, r] = p[some]
        alive &= ~((ALPHA * (1 - sim[p[:, None], cand]) <= dist) & some[:, None])
        alive &= cand != p[:, None]
    # edges both ways, the nearest 2 * DEGREE of a node
    src = np.repeat(np.arange(n), DEGREE)
    dst = out.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    key = np.unique(a * n + b)
    a, b = key // n, key % n
    order = np.lexsort((-sim[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    ok = place < 2 * DEGREE
    both = np.full((n, 2 * DEGREE), -1, dtype=np.int64)
    both[a[ok], place[ok]] = b[ok]
    return both


def medoid_of(v: np.ndarray) -> int:
    return int((v @ v.mean(axis=0)).argmax())


def range_search(v: np.ndarray, adj: np.ndarray, medoid: int, q: np.ndarray, own: np.ndarray,
                 threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs at or over the threshold found by greedy search from
    the medoid and range expansion; own: the query's own node or -1."""
    nq, n = len(q), len(v)
    seen = np.zeros((nq, n), dtype=bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def near(qi, xi, s):
        ok = s >= threshold - SLACK
        found.append((qi[ok], xi[ok], s[ok]))

    qs = np.arange(nq)
    node = np.full((nq, beam), -1, dtype=np.int64)
    sims = np.full((nq, beam), -np.inf)
    node[:, 0], sims[:, 0] = medoid, q @ v[medoid]
    seen[:, medoid] = True
    near(qs, node[:, 0], sims[:, 0])
    has = own >= 0
    fresh = has & (own != medoid)
    seen[qs[fresh], own[fresh]] = True
    near(qs[fresh], own[fresh], np.einsum("ij,ij->i", q[fresh], v[own[fresh]]))
    done = np.zeros((nq, beam), dtype=bool)
    live = qs
    while len(live):
        open_ = np.where(done[live] | (node[live] < 0), -np.inf, sims[live])
        pick = open_.argmax(axis=1)
        go = open_[np.arange(len(live)), pick] > -np.inf
        live, pick = live[go], pick[go]
        if not len(live):
            break
        done[live, pick] = True
        nb = adj[node[live, pick]]
        new = (nb >= 0) & ~seen[live[:, None], nb]
        qi, xi = np.repeat(live, nb.shape[1])[new.reshape(-1)], nb[new]
        seen[qi, xi] = True
        s = np.full(nb.shape, -np.inf)
        s[new] = np.einsum("ij,ij->i", q[qi], v[xi])
        near(qi, xi, s[new])
        all_n = np.hstack([node[live], np.where(new, nb, -1)])
        all_s = np.hstack([sims[live], s])
        all_d = np.hstack([done[live], np.zeros(nb.shape, dtype=bool)])
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        node[live] = np.take_along_axis(all_n, top, axis=1)
        sims[live] = np.take_along_axis(all_s, top, axis=1)
        done[live] = np.take_along_axis(all_d, top, axis=1)
    at = 0
    while at < len(found):                      # range expansion
        qi, xi, _ = found[at]
        at += 1
        for a in range(0, len(qi), 16_384):
            nb = adj[xi[a:a + 16_384]]
            qq = np.repeat(qi[a:a + 16_384], nb.shape[1])
            nb = nb.reshape(-1)
            ok = nb >= 0
            key = np.unique(qq[ok] * n + nb[ok])
            qq, nb = key // n, key % n
            new = ~seen[qq, nb]
            qq, nb = qq[new], nb[new]
            if len(qq):
                seen[qq, nb] = True
                near(qq, nb, np.einsum("ij,ij->i", q[qq], v[nb]))
    qi = np.concatenate([f[0] for f in found])
    xi = np.concatenate([f[1] for f in found])
    ok = np.concatenate([f[2] for f in found]) >= threshold
    return qi[ok], xi[ok]


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, a few rounds."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), size=min(k, len(sample)), replace=False)]
    for _ in range(6):
        near = np.concatenate([(sample[a:a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def shards_of(centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres within the threshold of each other, directly or by others, are one
    shard -> (centres in shard order, first centre of each shard)."""
    near = centres @ centres.T >= threshold
    label = np.arange(len(centres))
    while True:
        least = np.where(near, label[None, :], len(centres)).min(axis=1)
        if (least >= label).all():
            break
        label = np.minimum(label, least)
    order = np.argsort(label, kind="stable")
    label = label[order]
    return centres[order], np.flatnonzero(np.append(True, label[1:] != label[:-1]))


def nearest_shards(v: np.ndarray, centres: np.ndarray, starts: np.ndarray, overlap: int) -> np.ndarray:
    """The `overlap` nearest shards of each vector (all, if fewer), ascending."""
    k = min(overlap, len(starts))
    out = []
    for a in range(0, len(v), 4096):
        sim = np.maximum.reduceat(v[a:a + 4096] @ centres.T, starts, axis=1)
        out.append(np.sort(np.argpartition(-sim, k - 1, axis=1)[:, :k], axis=1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def _assign(shared, overlap):
    def run(batches):
        centres, starts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(vectors(batch.column("vec")))
            near = nearest_shards(v, centres, starts, overlap).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("weight"), _lists(near), _lists(v)],
                ["node", "weight", "shards", "vec"])
    return run


def _fit_split(batches):
    """Sampled rows (s, t, k, vec) of the shards to split, sorted by s -> their centres."""
    def solve(s, parts):
        k = int(parts[0][0][0].as_py())
        c = centres_of(np.concatenate([vectors(p[1]) for p in parts]), k)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), s)), _lists(c)], ["s", "vec"])

    now, parts = None, []
    for key, cols in _groups(batches, ["k", "vec"]):
        if key != now and parts:
            yield solve(now[0], parts)
            parts = []
        now = key
        parts.append(cols)
    if parts:
        yield solve(now[0], parts)


def _hand_on(threshold, overlap, max_centres):
    """Rows (s, t, node, vec) of a chunk, the shard's centres (node null) first ->
    (node, shards) of the next level."""
    def run(batches):
        now, found, ready = None, [], None
        for key, (node, vec) in _groups(batches, ["node", "vec"]):
            if key != now:
                now, found, ready = key, [], None
            cut = node.null_count
            if cut:
                found.append(vectors(vec.slice(0, cut)))
            if cut < len(node):
                ready = ready or shards_of(np.concatenate(found), threshold)
                near = nearest_shards(vectors(vec.slice(cut)), *ready, overlap) + key[0] * max_centres
                yield pa.RecordBatch.from_arrays([node.slice(cut), _lists(near.astype(np.int64))], ["node", "shards"])
    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _groups(batches, columns):
    """Rows sorted by (s, t) -> per group one list of numpy-ready columns per chunk;
    yields ((s, t), iterator of (columns of consecutive rows))."""
    for batch in batches:
        if not batch.num_rows:
            continue
        s, t = np.asarray(batch.column("s")), np.asarray(batch.column("t"))
        heads = np.append(np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))), len(s))
        for a, b in zip(heads[:-1], heads[1:]):
            yield (int(s[a]), int(t[a])), [batch.column(c).slice(a, b - a) for c in columns]


def _build(batches):
    """Robust-pruned adjacency lists of every shard part."""
    def solve(parts):
        node = np.concatenate([np.asarray(p[0]) for p in parts])
        v = np.concatenate([vectors(p[1]) for p in parts])
        adj = prune(v @ v.T, medoid_of(v), np.random.default_rng(SEED))
        lists = [node[a[a >= 0]].tolist() for a in adj]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(lists, pa.list_(pa.int64()))], ["node", "adj"])

    now, parts = None, []
    for key, cols in _groups(batches, ["node", "vec"]):
        if key != now and parts:
            yield solve(parts)
            parts = []
        now = key
        parts.append(cols)
    if parts:
        yield solve(parts)


class _Part:
    """One shard part under search: its nodes first, then the queries."""

    def __init__(self, shard: int, threshold: float, beam: int) -> None:
        self.shard, self.threshold, self.beam = shard, threshold, beam
        self.parts, self.ready = [], False

    def add(self, cols):
        """cols: node, weight, shards, vec, adj, own."""
        own = np.asarray(cols[5])
        if not self.ready and own.all():
            self.parts.append(cols[:5])
            return
        cut = int(own.sum()) if not self.ready else 0
        if cut:
            self.parts.append([c.slice(0, cut) for c in cols[:5]])
        if not self.ready:
            yield from self.close()
        rest = [c.slice(cut) for c in cols[:4]]
        if len(rest[0]):
            yield from self.query(np.asarray(rest[0]), vectors(rest[2]), vectors(rest[3]), None)

    def close(self):
        if self.ready or not self.parts:
            return
        self.ready = True
        self.node = np.concatenate([np.asarray(p[0]) for p in self.parts])
        self.weight = np.concatenate([np.asarray(p[1]) for p in self.parts])
        self.shards = np.concatenate([vectors(p[2]) for p in self.parts])
        self.v = np.concatenate([vectors(p[3]) for p in self.parts])
        order = np.argsort(self.node)
        sorted_nodes = self.node[order]
        lists = [p[4] for p in self.parts]
        size = np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists])
        flat = np.concatenate([np.asarray(x.flatten()) for x in lists])
        local = bs.lookup(sorted_nodes, flat)
        local = np.where(local >= 0, order[local], -1)
        self.adj = np.full((len(self.node), max(1, int(size.max(initial=0)))), -1, dtype=np.int64)
        place = np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
        self.adj[np.repeat(np.arange(len(size)), size), place] = local
        self.medoid = medoid_of(self.v)
        self.root = np.arange(len(self.node))
        self.parts = []
        yield from self.query(self.node, self.shards, self.v, np.arange(len(self.node)))
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        yield self._edges(self.node[moved], self.node[self.root[moved]])

    def _edges(self, u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()),
                                          pa.nulls(len(u), pa.int64())], ["u", "v", "n", "m"])

    def query(self, node, shards, vec, own):
        for a in range(0, len(node), 256):
            b = min(a + 256, len(node))
            mine = own[a:b] if own is not None else np.full(b - a, -1)
            qi, xi = range_search(self.v, self.adj, self.medoid, vec[a:b], mine, self.threshold, self.beam)
            keep = node[a:b][qi] != self.node[xi]
            qi, xi = qi[keep], xi[keep]
            least = np.full(len(qi), np.inf)     # smallest shard both belong to
            sq, sx = shards[a:b][qi], self.shards[xi]
            for i in range(sq.shape[1]):
                hit = (sq[:, i:i + 1] == sx).any(axis=1)
                least = np.where(hit, np.minimum(least, sq[:, i]), least)
            here = least == self.shard
            count = np.bincount(qi[here], weights=self.weight[xi[here]], minlength=b - a).astype(np.int64)
            distinct = np.bincount(qi[here], minlength=b - a)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[a:b][some]), pa.nulls(len(some), pa.int64()), pa.array(count[some]),
                 pa.array(distinct[some])], ["u", "v", "n", "m"])
            if own is None:
                key = np.unique(qi * len(self.node) + self.root[xi])
                yield self._edges(node[a:b][key // len(self.node)], self.node[key % len(self.node)])
            else:
                self._unite(mine[qi], xi)

    def _unite(self, a, b):
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            hi, lo = np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ]
            np.minimum.at(self.root, hi, lo)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _search(threshold, beam):
    def run(batches):
        now, part = None, None
        for key, cols in _groups(batches, ["node", "weight", "shards", "vec", "adj", "own"]):
            if key != now:
                if part is not None:
                    yield from part.close()
                now, part = key, _Part(key[0], threshold, beam)
            yield from part.add(cols)
        if part is not None:
            yield from part.close()
    return run


def _brute(shared, threshold):
    """Nodes within the range of each audit query, over one task's nodes."""
    def run(batches):
        ids, q = shared.value
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, node = vectors(batch.column("vec")), np.asarray(batch.column("node"))
            for a in range(0, len(node), 4096):
                total += ((q @ v[a:a + 4096].T >= threshold) & (ids[:, None] != node[None, a:a + 4096])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["u", "n"])
    return run


def _counted(members: DataFrame) -> DataFrame:
    """(s, n): nodes of each shard."""
    return members.select(F.explode(F.array_distinct("shards")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


def _split(members: DataFrame, threshold: float, shard_size: int, width: int, max_centres: int) -> DataFrame:
    """Shards over SPLIT_PARTS parts handed on to sub-shards. Ids of the next level
    are s * max_centres + sub-shard, those of shards that stay s * max_centres."""
    big = written(_counted(members).filter(F.col("n") > SPLIT_PARTS * shard_size)
                  .withColumn("k", F.least(F.lit(max_centres), F.ceil(F.col("n") * SUB_OVERLAP / shard_size)).cast("int"))
                  .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "vector-split")
    rows = members.select("node", "vec", F.explode(F.array_distinct("shards")).alias("s"))
    inside = rows.join(big, "s")
    share = F.least(F.lit(1.0), SUB_SAMPLE * F.col("k") / F.col("n"))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "node", "s"), F.lit(1 << 20)) < share * (1 << 20)
    # a shard's sample holds about SUB_SAMPLE * k vectors, at whatever size
    centres = written(inside.filter(drawn).select("s", F.lit(0).alias("t"), "k", "vec").repartition("s")
                      .sortWithinPartitions("s").mapInArrow(_fit_split, "s long, vec array<double>"), "vector-centres")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    each = (centres.join(big, "s").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("s", "t", F.lit(None).cast("long").alias("node"), "vec"))
    handed = (each.unionByName(inside.select("s", chunk.alias("t"), "node", "vec"))
              .repartition("s", "t").sortWithinPartitions("s", "t", F.asc_nulls_first("node"))
              .mapInArrow(_hand_on(threshold, SUB_OVERLAP, max_centres), "node long, shards array<long>"))
    stay = rows.join(big, "s", "left_anti").select("node", F.array(F.col("s") * max_centres).alias("shards"))
    deeper = (handed.unionByName(stay).groupBy("node")
              .agg(F.array_sort(F.flatten(F.collect_list("shards"))).alias("shards")))   # at most `width` of them
    padded = F.concat("shards", F.array_repeat(F.col("shards")[0], width - F.size("shards")))
    return written(members.drop("shards").join(deeper, "node")
                   .select("node", "weight", padded.alias("shards"), "vec"), "vector-members")


def _search_once(nodes: DataFrame, n: int, threshold: float, overlap: int, beam: int, shard_size: int,
                 max_centres: int):
    """(members, found): found has (u, null, n, m) counts, weighted and of
    different nodes, and (u, v, null, null) edges."""
    spark = nodes.sparkSession
    length = nodes.select(F.size("vec")).first()[0]
    sample = (nodes.orderBy(F.xxhash64(F.lit(SEED), "node")).limit(min(CENTRE_SAMPLE, max(1, SAMPLE_BYTES // (8 * length))))
              .select("vec").toArrow())
    k = min(max_centres, max(1, math.ceil(n * overlap / shard_size)))
    centres = shards_of(centres_of(unit(vectors(sample.column("vec").combine_chunks())), k), threshold)
    shared = spark.sparkContext.broadcast(centres)
    members = written(nodes.select("node", "weight", "vec").mapInArrow(
        _assign(shared, overlap), "node long, weight long, shards array<long>, vec array<double>"), "vector-members")
    width, over = min(overlap, len(centres[1])), None
    for _ in range(LEVELS):
        before, over = over, _counted(members).filter(F.col("n") > SPLIT_PARTS * shard_size).agg(F.sum("n")).first()[0]
        if over is None or over == before:          # what does not shrink are dense groups, which stay whole
            break
        width *= SUB_OVERLAP
        members = _split(members, threshold, shard_size, width, max_centres)
    # written, so that Spark knows its size and decides by it how the vectors meet it
    parts = written(_counted(members).select("s", F.ceil(F.col("n") / F.lit(shard_size)).cast("int").alias("parts")),
                    "vector-parts")
    placed = (members.withColumn("s", F.explode(F.array_distinct("shards"))).join(parts, "s")
              .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    graph = (placed.select("s", F.col("mine").alias("t"), "node", "vec")
             .repartition("s", "t").sortWithinPartitions("s", "t")
             .mapInArrow(_build, "node long, adj array<long>")
             .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj")))
    graph = written(graph, "vector-graph")
    sent = (placed.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("own", F.col("t") == F.col("mine")).drop("parts", "mine").join(graph, "node")
            .select("s", "t", "own", "node", "weight", "shards", "vec",
                    F.when(F.col("own"), F.col("adj")).otherwise(F.array().cast("array<long>")).alias("adj")))
    found = written(sent.repartition("s", "t").sortWithinPartitions("s", "t", F.desc("own"))
                    .mapInArrow(_search(threshold, beam), "u long, v long, n long, m long"), "vector-links")
    return members, found


def _audit(members: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT_QUERIES) -> float | None:
    """The lower recall of two draws of nodes: of all, and of those with links."""
    spark = members.sparkSession
    linked = found.filter("m is not null").groupBy(F.col("u").alias("node")).agg(F.sum("m").alias("m"))
    order = F.xxhash64(F.lit(SEED + 1), "node")
    draws = [set(r["node"] for r in d.select("node").orderBy(order).limit(queries).collect()) for d in (members, linked)]
    picked = members.filter(F.col("node").isin(list(draws[0] | draws[1]))).select("node", "vec").toArrow()
    ids = np.asarray(picked.column("node").combine_chunks())
    if not len(ids):
        return None
    shared = spark.sparkContext.broadcast((ids, vectors(picked.column("vec").combine_chunks())))
    truth = (members.select("node", "vec").mapInArrow(_brute(shared, threshold), "u long, n long")
             .groupBy("u").agg(F.sum("n").alias("n")))
    # at most 2 * queries rows each
    want = {r["u"]: r["n"] for r in truth.filter("n > 0").collect()}
    got = {r["node"]: r["m"] for r in linked.filter(F.col("node").isin(ids.tolist())).collect()}
    shares = [[min(got.get(u, 0), want[u]) / want[u] for u in d if u in want] for d in draws]
    return min((sum(x) / len(x) for x in shares if x), default=None)


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                           threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM,
                           shard_size: int = SHARD_SIZE, min_recall: float = MIN_RECALL,
                           max_centres: int = MAX_CENTRES) -> DataFrame:
    """(id, n_links, component, recall): one row per vector; component is the
    smallest id reachable by links (its own without any); recall is that of the
    audit of the vectors of that length (null for vectors that cannot link, and where
    no audited node has a link)."""
    v = F.col("vec")
    inf = float("inf")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)) \
        & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    ok = base.filter(good).withColumn("h", F.xxhash64("vec"))
    nodes = written(ok.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
                    .withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = nodes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    result = None
    for r in lengths:
        of_length = nodes.filter(F.size("vec") == r["d"])
        wide, broad = overlap, beam
        for attempt in range(ATTEMPTS):
            members, found = _search_once(of_length, r["n"], threshold, wide, broad, shard_size, max_centres)
            recall = _audit(members, found, threshold)
            if recall is None or recall >= min_recall:
                break
            log.warning("audited recall %.3f is under %.3f; building the graph with more overlap", recall, min_recall)
            wide, broad = 2 * wide, 2 * broad
        else:
            raise RecallError(f"audited recall {recall:.3f} of the vectors of length {r['d']} is under {min_recall}")
        counts = found.filter("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
        comp = connected_components(found.filter("v is not null").select("u", "v"))
        rooted = (of_length.select("node", "rep", "weight", "vec").join(counts, "node", "left")
                  .join(comp, "node", "left")
                  .select("vec", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                          F.coalesce("root", "node").alias("root")))
        least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
        part = (rooted.join(least, "root").select("vec", "n_links", "component", F.lit(recall).cast("double").alias("recall")))
        result = part if result is None else result.unionByName(part)
    lone = base.filter(~F.coalesce(good, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"),
        F.lit(None).cast("double").alias("recall"))
    if result is None:
        return lone
    return ok.join(result, "vec").select("id", "n_links", "component", "recall").unionByName(lone)
