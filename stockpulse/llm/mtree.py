"""Exact top-k search by inner product with M-trees.

Vectors become integer vectors floor(64 x); the score of two is their inner product. With
one more component, sqrt(M^2 - |v|^2) for the rows and 0 for the queries (M the largest
norm), the Euclidean distance of a query to a row falls exactly as the score rises, so
the search for high scores is a nearest-neighbour search in a metric space.

Rows are dealt to shards: the nearest of at most `max_centres` centres (the vectors with the
least seeded hash, a documented sample), and within a large cluster a hash part, so that no
shard holds more than some `shard_values` components, however many near copies there are.
Each shard is an M-tree: pages of `PAGE` entries that store a routing vector, its covering
radius and its distance to the page's own routing vector. A block of queries visits pages
best first; |d(query, parent) - d(parent, entry)| - radius bounds an entry's distance
before it is computed, and entries that no query of the block can need are not computed.

Two rounds: every query searches the cluster whose ball is nearest, then, with the k-th score
found there as bound, the clusters whose balls still reach it (all of them, if need be).
Scores are computed from the integers and are exact; distances only choose what to skip,
with `SLACK` for their rounding.

Equal query vectors are searched once and equal rows kept up to the k + 1 least ids (no
result needs more), so groups of copies cost no more than one vector; the own row is
taken out afterwards. Nothing but the centres and one line per cluster reaches the driver.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do empty ones; vectors of another length have no score with a query; components and
scores beyond 64 bits are held at its limits; rows of one id are rows of their own (each
excludes only itself); a null id is no query and comes last among equal scores; fewer
candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpulse.llm.scratch import written

SCALE = 64
TOP = 20
PAGE = 64
MAX_CENTRES = 256
CLUSTER_ROWS = 4096        # rows wanted in a cluster
SHARD_VALUES = 1 << 21     # vector components in a shard
BLOCK = 256                # queries that search together
SLACK = 1e-6               # share of the space's diameter
EXACT = float(1 << 52)     # products of norms up to here are exact in doubles
LONG = np.iinfo(np.int64)


def quantised(vector: Column) -> Column:
    """floor(64 x) of every component, null if the vector takes no part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(x) > 0) & ~bad, F.transform(x, lambda c: F.floor(F.greatest(F.least(
        c * SCALE, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long")))


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact (held at the limits of 64 bits)."""
    if not len(q) or not len(rows):
        return np.zeros((len(q), len(rows)), dtype=np.int64)
    qf, rf = q.astype(np.float64), rows.astype(np.float64)
    if np.sqrt((qf * qf).sum(axis=1).max() * (rf * rf).sum(axis=1).max()) <= EXACT:
        return (qf @ rf.T).astype(np.int64)
    wide = q.astype(object) @ rows.astype(object).T
    return np.clip(wide, int(LONG.min), int(LONG.max)).astype(np.int64)


def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that brings their norm to `top`."""
    x = rows.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


class Page:
    """Entries below one routing vector: rows of the shard (a leaf) or further pages."""

    __slots__ = ("at", "parent", "radius", "below")

    def __init__(self, at, parent, radius=None, below=None) -> None:
        self.at = at              # the entries' vectors, as row numbers
        self.parent = parent      # their distances to this page's routing vector
        self.radius = radius      # covering radii (inner pages)
        self.below = below        # the pages (inner pages)


class MTree:
    def __init__(self, rows: np.ndarray, top: float) -> None:
        self.rows, self.top = rows, top
        self.space = lifted(rows, top)
        self.root = self._page(np.arange(len(rows)), 0) if len(rows) else None
        self.computed = self.skipped = 0

    def _page(self, at: np.ndarray, router: int) -> Page:
        """Bulk load: entries by nearest of evenly spread seeds, recursively."""
        near = distances(self.space[at], self.space[router:router + 1])[:, 0]
        if len(at) <= PAGE:
            return Page(at, near)
        seeds = at[np.argsort(near, kind="stable")[np.linspace(0, len(at) - 1, min(PAGE, -(-len(at) // PAGE) + 1), dtype=int)]]
        seeds = np.unique(seeds)
        owner = np.argmin(distances(self.space[at], self.space[seeds]), axis=1)
        groups = [at[owner == j] for j in range(len(seeds))]
        if max(len(g) for g in groups) > 0.9 * len(at):    # near copies: equal parts by distance
            groups = np.array_split(at[np.argsort(near, kind="stable")], min(PAGE, -(-len(at) // PAGE)))
        groups = [g for g in groups if len(g)]
        routers, radii, below = [], [], []
        for g in groups:
            # the member nearest to the middle routes
            middle = self.space[g].mean(axis=0, keepdims=True)
            r = int(g[np.argmin(distances(self.space[g], middle)[:, 0])])
            routers.append(r)
            radii.append(distances(self.space[g], self.space[r:r + 1])[:, 0].max())
            below.append(self._page(g, r))
        routers = np.array(routers)
        return Page(routers, distances(self.space[routers], self.space[router:router + 1])[:, 0], np.array(radii), below)

    def search(self, q: np.ndarray, best: "Best") -> None:
        """Fill `best` with the rows of the highest scores for each query of the block."""
        if self.root is None or not len(q):
            return
        sq = (q.astype(np.float64) ** 2).sum(axis=1)
        slack = SLACK * (np.sqrt(sq) + self.top)
        flat = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        start = distances(flat, self.space[:1])[:, 0]     # the root page's routing vector is row 0
        heap = [(0.0, 0, self.root, start, np.zeros(len(q)))]
        tie = 0
        while heap:
            _, _, page, to_parent, least = heapq.heappop(heap)
            reach = best.reach(sq, self.top) + slack
            act = np.flatnonzero(least <= reach)
            if not len(act):
                continue
            leaf = page.below is None
            bound = np.abs(to_parent[act, None] - page.parent[None, :]) - (0 if leaf else page.radius[None, :])
            may = bound <= reach[act, None]
            cols = np.flatnonzero(may.any(axis=0))
            self.computed += len(act) * len(cols)
            self.skipped += len(act) * (len(page.at) - len(cols))
            if not len(cols):
                continue
            if leaf:
                best.offer(act, page.at[cols], products(q[act], self.rows[page.at[cols]]), may[:, cols])
                continue
            d = distances(flat[act], self.space[page.at[cols]])
            low = np.where(may[:, cols], d - page.radius[cols], np.inf)
            for j, c in enumerate(cols):
                if (low[:, j] <= reach[act]).any():
                    far = np.zeros(len(q))
                    far[act] = d[:, j]
                    bounds = np.full(len(q), np.inf)
                    bounds[act] = low[:, j]
                    tie += 1
                    heapq.heappush(heap, (float(low[:, j].min()), tie, page.below[c], far, bounds))


class Best:
    """The k best (score, id) per query, rows sorted; `ids` and `none` (null id) are the shard's."""

    def __init__(self, queries: int, k: int, ids: np.ndarray, none: np.ndarray, known: np.ndarray, has: np.ndarray) -> None:
        self.ids, self.none, self.k = ids, none, k
        self.known, self.has = known, has           # k-th score of an earlier search, if it found k rows
        self.score = np.full((queries, k), LONG.min)
        self.row = np.full((queries, k), -1)

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """(score a row has to reach, whether there is one)."""
        full = self.row[:, -1] >= 0
        s = np.where(full, self.score[:, -1], LONG.min)
        return np.where(self.has, np.maximum(s, self.known), s), full | self.has

    def reach(self, sq: np.ndarray, top: float) -> np.ndarray:
        """Distance beyond which no row scores enough."""
        s, some = self.least()
        return np.where(some, np.sqrt(np.maximum(sq + top * top - 2 * s.astype(np.float64), 0)), np.inf)

    def offer(self, act: np.ndarray, rows: np.ndarray, scores: np.ndarray, may: np.ndarray) -> None:
        s, some = self.least()
        good = may & ((scores >= s[act, None]) | ~some[act, None])
        for i in np.flatnonzero(good.any(axis=1)):
            g, a = np.flatnonzero(good[i]), act[i]
            old = self.row[a] >= 0
            score = np.concatenate([self.score[a][old], scores[i, g]])
            row = np.concatenate([self.row[a][old], rows[g]])
            order = np.lexsort((self.ids[row], self.none[row], -score))[:self.k]
            self.score[a, :len(order)], self.row[a, :len(order)] = score[order], row[order]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten() if not isinstance(col, pa.ChunkedArray) else col.combine_chunks().flatten()
    return np.asarray(flat).reshape(len(col), -1)


def _assign(shared):
    """Adds cluster and distance to its centre."""
    def run(batches):
        centres, top = shared.value
        for batch in batches:
            n = np.asarray(batch.column("n"))
            cluster, far = np.zeros(len(n), np.int32), np.zeros(len(n))
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                x = _matrix(batch.column("v").take(pa.array(at)))
                space, first = lifted(x, top[int(dim)]), centres[int(dim)]
                d = distances(space, lifted(first, top[int(dim)]))
                cluster[at] = d.argmin(axis=1)
                far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(far)],
                                             [*batch.schema.names, "cluster", "far"])
    return run


def _routes(shared, first: bool):
    """(q, n, v, least, some) -> one row per cluster to search: the nearest one, or the
    others that the known k-th score leaves in reach."""
    def run(batches):
        centres, top, radius = shared.value
        for batch in batches:
            n = np.asarray(batch.column("n"))
            out_q, out_c = [], []
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                dim = int(dim)
                q = _matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                sq = (q * q).sum(axis=1)
                flat = np.column_stack([q, np.zeros(len(q))])
                low = np.maximum(distances(flat, lifted(centres[dim], top[dim])) - radius[dim][None, :], 0)
                home = low.argmin(axis=1)
                if first:
                    out_q.append(at)
                    out_c.append(home)
                    continue
                some = np.asarray(batch.column("some"))[at]
                s = np.asarray(batch.column("least").fill_null(0))[at].astype(np.float64)
                reach = np.where(some, np.sqrt(np.maximum(sq + top[dim] ** 2 - 2 * s, 0)), np.inf)
                hit = low <= (reach + SLACK * (np.sqrt(sq) + top[dim]))[:, None]
                hit[np.arange(len(at)), home] = False
                i, c = np.nonzero(hit & np.isfinite(radius[dim])[None, :])
                out_q.append(at[i])
                out_c.append(c)
            i = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
            for a in range(0, max(len(i), 1), 4096):
                part = batch.take(pa.array(i[a:a + 4096]))
                c = np.concatenate(out_c)[a:a + 4096] if out_c else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.astype(np.int32))],
                                                 [*part.schema.names, "cluster"])
    return run


def _search(k: int, shared):
    """Rows sorted by shard (n, cluster, part), the shard's rows before its queries."""
    def run(batches):
        _, top, _ = shared.value
        shard, rows, ids, none, tree, asked = None, [], [], [], None, []

        def answer():
            nonlocal tree, asked
            if not asked or not rows:
                asked = []
                return
            if tree is None:
                tree = MTree(np.concatenate(rows), top[shard[0]])
            num = np.concatenate(ids)
            null = np.concatenate(none)
            q = np.concatenate([a[0] for a in asked])
            best = Best(len(q), k, num, null, np.concatenate([a[3] for a in asked]), np.concatenate([a[4] for a in asked]))
            tree.search(q, best)
            i, j = np.nonzero(best.row >= 0)
            row = best.row[i, j]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a[x] for a in asked])[i]) for x in (1, 2)]
                + [pa.array(best.score[i, j]), pa.array(num[row], mask=null[row])], ["q1", "q2", "score", "id"])
            asked = []

        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)) for c in ("n", "cluster", "part", "is_query")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(key))):
                if a == b:
                    continue
                part = batch.slice(int(a), int(b - a))
                now = tuple(key[a, :3].tolist())
                if now != shard:
                    yield from answer()
                    shard, rows, ids, none, tree = now, [], [], [], None
                v = _matrix(part.column("v"))
                col = part.column("id")
                if not key[a, 3]:
                    rows.append(v)
                    ids.append(np.asarray(col.fill_null(0)))
                    none.append(np.asarray(col.is_null()))
                    continue
                for s in range(0, len(v), BLOCK):
                    asked.append((v[s:s + BLOCK], *(np.asarray(part.column(c).fill_null(0))[s:s + BLOCK] for c in ("q1", "q2", "least")),
                                  np.asarray(part.column("some"))[s:s + BLOCK]))
                    if sum(len(x[0]) for x in asked) >= BLOCK:
                        yield from answer()
        yield from answer()
    return run


def search(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
           max_centres: int = MAX_CENTRES, shard_values: int = SHARD_VALUES) -> DataFrame:
    """(query_id, rank, id, score): for the rows of `is_query` (over the column `id`, a long) the k
    other rows with the highest scores."""
    spark = vectors.sparkSession
    v = quantised(F.col(vector_col))
    rows = written(vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("v is not null")
                   .withColumn("n", F.size("v")), "top-rows")
    # of equal vectors the k + 1 least ids (cut before the shuffle)
    copy = F.row_number().over(Window.partitionBy("n", "v").orderBy(F.asc_nulls_last("id")))
    kept = written(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1), "top-kept")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    dims = kept.groupBy("n").agg(F.count("*").alias("c"), F.max(norm).alias("top")).toPandas()
    least_hash = F.row_number().over(Window.partitionBy("n").orderBy("h", "v"))
    drawn = (kept.filter("copy = 1").select("n", "v", F.xxhash64(F.lit(11), "v").alias("h"))
             .withColumn("r", least_hash).filter(F.col("r") <= max_centres).orderBy("n", "r").toArrow())
    of = np.asarray(drawn.column("n").combine_chunks())
    centres, top = {}, {}
    for dim, count, norm_max in dims.itertuples(index=False):
        want = min(max_centres, int(count) // CLUSTER_ROWS + 1)
        centres[int(dim)] = _matrix(drawn.column("v").take(pa.array(np.flatnonzero(of == dim)[:want])))
        top[int(dim)] = float(np.nextafter(norm_max, np.inf)) if norm_max else 1.0
    asks = rows.filter(F.coalesce(is_query, F.lit(False))).select(
        "id", "n", "v", F.xxhash64(F.lit(1), "v").alias("q1"), F.xxhash64(F.lit(2), "v").alias("q2"))
    queries = asks.groupBy("n", "v", "q1", "q2").agg(F.count("*").alias("rows")).drop("rows")
    fitted = spark.sparkContext.broadcast((centres, top))
    found = T.StructType([*kept.select("id", "n", "v").schema.fields, T.StructField("cluster", T.IntegerType()),
                          T.StructField("far", T.DoubleType())])
    placed = written(kept.select("id", "n", "v").mapInArrow(_assign(fitted), found), "top-clusters")
    # one line per cluster: its radius, and its parts so that a shard stays bounded
    lines = placed.groupBy("n", "cluster").agg(F.max("far").alias("far"), F.count("*").alias("c")).toPandas()
    radius = {dim: np.full(len(c), -np.inf) for dim, c in centres.items()}    # without rows: never in reach
    sizes = []
    for dim, cluster, far, count in lines.itertuples(index=False):
        radius[int(dim)][int(cluster)] = far + SLACK * top[int(dim)]
        sizes.append((int(dim), int(cluster), max(1, -(-int(count) * int(dim) // shard_values))))
    shared = spark.sparkContext.broadcast((centres, top, radius))
    parts = F.broadcast(spark.createDataFrame(sizes, "n int, cluster int, parts int"))    # a line per centre at most
    shards = (placed.join(parts, ["n", "cluster"])
              .select("n", "cluster", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"),
                      F.lit(0).alias("is_query"), "id", "v", F.lit(0).cast("long").alias("q1"),
                      F.lit(0).cast("long").alias("q2"), F.lit(None).cast("long").alias("least"), F.lit(False).alias("some")))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    asked = queries.select("n", "v", "q1", "q2", F.lit(None).cast("long").alias("least"), F.lit(False).alias("some"))
    near = None
    for first in (True, False):
        routed = T.StructType([*asked.schema.fields, T.StructField("cluster", T.IntegerType())])
        sent = (asked.mapInArrow(_routes(shared, first), routed).join(parts, ["n", "cluster"])
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .select("n", "cluster", "part", F.lit(1).alias("is_query"), F.lit(None).cast("long").alias("id"),
                        "v", "q1", "q2", "least", "some"))
        # rows of shards that no query asks are not sent
        hit = (shards.unionByName(sent).repartition("n", "cluster", "part")
               .sortWithinPartitions("n", "cluster", "part", "is_query")
               .mapInArrow(_search(k + 1, shared), "q1 long, q2 long, score long, id long"))
        hit = hit if near is None else near.unionByName(hit)
        near = written(hit.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1), "top-found")
        kth = near.filter(F.col("rank") == k + 1).select("q1", "q2", F.col("score").alias("least"))
        asked = (queries.join(kth, ["q1", "q2"], "left")
                 .select("n", "v", "q1", "q2", "least", F.col("least").isNotNull().alias("some")))
        near = near.drop("rank")
    lists = near.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score").cast("decimal(20,0)")).alias("order"), F.col("id").isNull().alias("none"), "id", "score"))).alias("all"))
    ranked = asks.withColumn("own", _self_score("v")).join(lists, ["q1", "q2"])
    at = F.array_position(F.transform("all", lambda e: e["id"].eqNullSafe(F.col("id")) & (e["score"] == F.col("own"))), F.lit(True))
    others = F.when(at > 0, F.concat(F.slice("all", F.lit(1), at - 1), F.slice("all", at + 1, F.lit(k)))).otherwise(F.col("all"))
    return (ranked.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, F.lit(1), F.lit(k))))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("id"), F.col("col.score").alias("score")))


def _self_score(vector: str) -> Column:
    """The vector's score with itself, held at the limit of 64 bits."""
    whole = F.expr(f"aggregate({vector}, cast(0 as decimal(38,0)), (a, x) -> "
                   "cast(a + cast(x as decimal(19,0)) * cast(x as decimal(19,0)) as decimal(38,0)))")
    rough = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(rough > 1e19, F.lit(int(LONG.max))) \
        .otherwise(F.least(whole, F.lit(int(LONG.max)).cast("decimal(38,0)")).cast("long"))
