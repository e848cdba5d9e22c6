"""Connected components over an edge table, by alternating large-star and
small-star steps. Each step is a grouped minimum (combined before the shuffle)
and a join on the node, whose large partitions Spark can split; after each round
the edges are written to the shared folder, so lineage stays short. Nothing is
collected but a count and a checksum per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpulse.llm.scratch import written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of one orderable type, any order, loops and repeats
    allowed -> (node, root): root is the smallest node of the component. Nodes
    without an edge to another node are absent; an empty table gives none."""
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct(), "cc-edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = written(small.select("u", F.col("m").alias("v"))
                    .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                    .distinct(), "cc-edges")
        before, state = state, _state(e)
        if before == state:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


class Forest:
    """Union-find inside a task: keeps at most one edge less than it has nodes."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if b < a:
                a, b = b, a
            self.up[b] = a
            self.up.setdefault(a, a)

    def edges(self):
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
