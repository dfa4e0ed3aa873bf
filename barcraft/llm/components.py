"""Connected components of an edge table: local union-find, then distributed contraction.

No task holds more than a partition of edges and nothing is collected.  Each round, every
partition replaces its edges by the spanning forest that union-find gives (at most one row
per node), every node then points to its least neighbour, pointers are shortened, and the
edges are contracted.  Once a forest has at most LOCAL_EDGES edges, one task ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcraft.llm.scratch import Scratch

#: Edges that one union-find holds: more in a partition are taken in runs of this size, and a
#: graph that has no more is settled by one.
LOCAL_EDGES = 1 << 18


class UnionFind:
    """Disjoint sets whose root is the least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(sets: UnionFind) -> pa.RecordBatch:
        rows = [(sets.find(x), x) for x in sets.parent]
        rows = [(a, b) for a, b in rows if a != b]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    sets, n = UnionFind(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield out(sets)
            sets, n = UnionFind(), 0
    yield out(sets)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, up) of every node of a graph that one union-find holds."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
    nodes = list(sets.parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], ["node", "up"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``, label the least node reachable.

    Edges may repeat, point either way or to themselves; nulls are left out.  No edges:
    no rows."""
    clean = edges.where("a is not null and b is not null").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    current = scratch.write(f"{name}_e0", clean.mapInArrow(_forest, "a long, b long").distinct())
    labels, k = None, 0
    while left := current.count():
        last = left <= LOCAL_EDGES
        if last:
            point = scratch.write(f"{name}_q{k}", current.repartition(1).mapInArrow(_roots, "node long, up long"))
        else:
            both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
            least = scratch.write(f"{name}_p{k}", least)
            # two jumps: node -> up -> up's up
            upper = least.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            point = scratch.write(f"{name}_q{k}", least.join(upper, "up").select("node", F.col("upper").alias("up")))
        if labels is None:
            labels = point.withColumnRenamed("up", "label")
        else:
            step = point.select(F.col("node").alias("label"), "up")
            labels = scratch.write(f"{name}_l{k}", labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        if last:
            break
        pa_, pb = point.select(F.col("node").alias("a"), F.col("up").alias("ra")), point.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        lifted = current.join(pa_, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        k += 1
        current = scratch.write(f"{name}_e{k}", lifted.mapInArrow(_forest, "a long, b long").distinct())
    if labels is None:
        labels = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    loops = clean.where("a = b").select(F.col("a").alias("node")).distinct()
    return labels.unionByName(loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
