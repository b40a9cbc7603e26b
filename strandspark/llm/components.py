"""Connected components of a graph of ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges up to which one task finds the components (some 30 MB); more stay distributed.
SMALL = 200_000


class Union:
    """Disjoint sets of numbers; the smallest of a set stands for it."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        self.up[max(a, b)] = min(a, b)


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(a, b)
    nodes = list(sets.up)
    for k in range(0, len(nodes), 50_000):
        some = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([sets.find(x) for x in some], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """node, component (its smallest node) for each node that has an edge in edges (a, b: long). Edges
    stay distributed, but for graphs of no more than `small` edges; the number of rounds grows with the
    logarithm of the longest path."""
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.limit(small + 1).count() <= small:
        return scratch.put(now.repartition(1).mapInArrow(_in_one_task, "node long, component long"))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the edges of a node with very many can be split among tasks in the join
        least = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        then = scratch.put(small_star)
        got = then.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        scratch.drop(now, least)
        now = then
        if (got.n, got.x) == mark:
            break
        mark = (got.n, got.x)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
