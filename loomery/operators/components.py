"""Connected components of an edge table, by star contraction: inside each task, then by large-star and small-star steps.

In a round each task first contracts the edges that it holds to stars, which takes no shuffle; then each of the two
steps is a join and an aggregation over all tasks. The number of rounds grows with the logarithm of the graph, not with
its diameter, and edges that need one task only are done after the first half of a round. Nothing is collected; each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.session import drop_staged, stage_table, tasks_for

#: Edges that a task contracts together.
TOGETHER = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stars of the edges ``u``, ``v``: every node but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        # every root goes to its least neighbour among roots, then every node to its root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        ends = contracted(*(edges.column(c).to_numpy() for c in "uv"))
        return pa.RecordBatch.from_arrays([pa.array(x, edges.schema.field(c).type) for x, c in zip(ends, "uv")], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= TOGETHER:
            yield stars()
            held.clear()
    if held:
        yield stars()


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Return ``id`` and ``component``, the least id reachable, for every id with an edge to another.

    Edges count in both directions; loops, repeats and null ends do nothing. No edges: no rows. It goes on until a round
    changes nothing. The joins are by node; a node with very many edges is split over tasks by adaptive execution.
    Rounds have as many tasks as their edges need.
    """
    current = stage_table(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u > v").distinct(), "edges"
    )
    n, signature = current.count(), None
    while n:
        k = tasks_for(n)
        before, current = current, stage_table(current.coalesce(k).mapInArrow(_contract, current.schema), "edges", k)
        drop_staged(before)
        if k == 1 and n <= TOGETHER:
            break  # all edges have been contracted together
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * k)
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u > v").coalesce(k).distinct().coalesce(k)
        small = large.join(_least_neighbour(large), "u").coalesce(k)
        small = small.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(small.select("u", F.col("_m").alias("v")))
        before, current = current, stage_table(small.filter("u > v").coalesce(k).distinct(), "edges", k)
        drop_staged(before)
        now = current.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if signature == tuple(now):
            break
        n, signature = now["n"], tuple(now)
    # stars: every edge leads to the least id of its component
    members = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())
