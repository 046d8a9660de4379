"""Connected components over an edge table, distributed end to end.

Partitions thin their own edges to spanning forests first. Once few enough
edges are left (a counted bound), one task finishes them; until then the graph
is contracted by alternating large-star / small-star steps. Minima are partial
aggregates kept as tables of their own, and the fan-out is an equi-join of two
plain shuffles, so AQE can split a hub that holds a large share of all edges;
no neighbour list is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postforge.session import cut

#: Edges a task holds at a time while it thins its own partition.
LOCAL_EDGES = 500_000
#: Edges that one task may finish: at most LOCAL_EDGES.
FINISH_EDGES = 400_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a-b, roots left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            parent[p] = x
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    nodes = list(parent)
    roots = [root(x) for x in nodes]
    return np.array(nodes, np.int64), np.array(roots, np.int64)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, b = spanning_forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _are_stars(e: DataFrame) -> bool:
    """Has every node one larger-to-smaller edge at most, and no centre one?"""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()[0]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: two non-null long columns. Returns (node, component), one row
    for each node of an edge; component is the smallest node reachable.

    Empty edges give an empty result. Self-loops and repeats are harmless.
    """
    first, second = edges.columns[:2]
    e = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).where("a <> b")
    e = cut(e.mapInArrow(_thin, "a long, b long"))
    for _ in range(rounds):
        if e.count() <= FINISH_EDGES:
            e = cut(e.coalesce(1).mapInArrow(_thin, "a long, b long"))
            break
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.mapInArrow(_thin, "a long, b long"))
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).mapInArrow(_thin, "a long, b long").distinct())
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
