"""Betweenness, neighbourhood features and flags of graph nodes, and tables that carry them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators.blocks import matrix
from loomery.operators.graph import SENT_NODES, packed, undirected
from loomery.session import drop_staged, stage_table


def betweenness(edges: DataFrame, sources: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Approximate betweenness of every node with an edge, from ``k`` sources by shortest paths in both directions: ``id``, ``betweenness``.

    Sources are the first ``k`` nodes by md5 of their id, or those given (``id``). They go level by level: outwards, the
    number of shortest paths to each node; back again, what flows through it. Sums are over ``k (n - 1)(n - 2) / 2``
    pairs, at most 1. A level is a pass over the written lists of neighbours, without a shuffle: the numbers of the level
    before are sent to the tasks, for as many sources at once as ``SENT_BYTES`` hold.
    """
    both = stage_table(undirected(edges), "links")
    ids = both.select(F.col("src").alias("id")).distinct()
    chosen = (sources if sources is not None else ids.orderBy(F.md5(F.col("id").cast("string")), "id").limit(k)).select("id").distinct()
    n, n_sources = ids.count(), chosen.count()
    if n > SENT_NODES:
        return _by_joins(both, chosen, n, n_sources)
    if not n:
        return ids.withColumn("betweenness", F.lit(0.0))
    nodes, near, n = packed(both)
    starts = nodes.join(chosen, "id").select("at").toArrow().column("at").to_numpy()
    total, together = np.zeros(n), max(1, SENT_BYTES // (8 * n))
    for i in range(0, len(starts), together):
        total += _flows(near, n, starts[i : i + together])
    pairs = n_sources * (n - 1) * (n - 2) / 2
    known = both.sparkSession.sparkContext.broadcast(np.minimum(1.0, total / pairs) if pairs > 0 else np.zeros(n))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(known.value[x.column(1).to_numpy()])], names=["id", "betweenness"])

    drop_staged(both, near)
    return nodes.mapInArrow(name, f"id {nodes.schema['id'].dataType.simpleString()}, betweenness double")


#: Bytes of the numbers that are sent for a level, about; one number a node is sent at least.
SENT_BYTES = 32_000_000


def _flows(near: DataFrame, n: int, starts: np.ndarray) -> np.ndarray:
    """What flows through each node on the shortest paths from ``starts``, all of them added."""
    level, paths = np.full((n, len(starts)), -1, np.int32), np.zeros((n, len(starts)))
    level[starts, np.arange(len(starts))], paths[starts, np.arange(len(starts))] = 0, 1.0
    depth = 0
    while True:
        at, got = _neighbour_sums(near, np.where(level == depth, paths, 0.0))
        new = (level[at] < 0) & (got > 0)
        if not new.any():
            break
        depth += 1
        rows, cols = np.nonzero(new)
        level[at[rows], cols], paths[at[rows], cols] = depth, got[new]
    delta = np.zeros(paths.shape)
    for d in range(depth, 1, -1):  # what comes back to a source itself does not count
        share = np.zeros(paths.shape)
        np.divide(1.0 + delta, paths, out=share, where=level == d)
        at, got = _neighbour_sums(near, share)
        rows, cols = np.nonzero(level[at] == d - 1)
        delta[at[rows], cols] = paths[at[rows], cols] * got[rows, cols]
    return delta.sum(1)


def _neighbour_sums(near: DataFrame, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with a neighbour whose numbers are not all 0, and the sums of their neighbours' numbers."""
    sent = near.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                size = part.column("near").value_lengths().to_numpy()
                sums = np.add.reduceat(sent.value[part.column("near").flatten().to_numpy()], np.cumsum(size) - size, axis=0)
                some = sums.any(axis=1)
                ends = np.arange(0, some.sum() * sums.shape[1] + 1, sums.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("at").filter(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(sums[some].ravel()))], names=["at", "x"])

    found = near.mapInArrow(run, "at int, x array<double>").toArrow()
    sent.unpersist()
    return found.column("at").to_numpy(), matrix(found.column("x")) if found.num_rows else np.zeros((0, numbers.shape[1]))


def _by_joins(both: DataFrame, chosen: DataFrame, n: int, n_sources: int) -> DataFrame:
    """Betweenness by joins, all sources together, level by level."""
    nodes = both.select(F.col("src").alias("id")).distinct()
    levels = [stage_table(chosen.distinct().select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("s", "id")
    while True:
        step = levels[-1].join(both, levels[-1]["id"] == both["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = stage_table(step.join(seen, ["s", "id"], "left_anti"), "level")
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("s", "id"))
    flows, delta = [], None
    for up, down in zip(levels[-2::-1], levels[:0:-1]):
        told = down.join(delta, ["s", "id"], "left") if delta is not None else down.withColumn("delta", F.lit(None).cast("double"))
        share = told.select("s", F.col("id").alias("to"), ((1.0 + F.coalesce("delta", F.lit(0.0))) / F.col("paths")).alias("part"))
        back = up.join(both, up["id"] == both["src"]).join(share.withColumnRenamed("to", "dst"), ["s", "dst"])
        delta = stage_table(back.groupBy("s", "id").agg(F.sum(F.col("paths") * F.col("part")).alias("delta")), "flow")
        flows.append(delta)
    pairs = n_sources * (n - 1) * (n - 2) / 2
    if not flows or pairs <= 0:
        return nodes.withColumn("betweenness", F.lit(0.0))
    inner = reduce(DataFrame.unionByName, flows).filter("s <> id").groupBy("id").agg(F.sum("delta").alias("_b"))
    out = nodes.join(inner, "id", "left").select("id", F.least(F.lit(1.0), F.coalesce("_b", F.lit(0.0)) / pairs).alias("betweenness"))
    out = stage_table(out, "betweenness")
    drop_staged(both, *levels, *flows)
    return out


def neighbourhood_features(edges: DataFrame, fraud: DataFrame) -> DataFrame:
    """Per node: share of its neighbours in ``fraud`` (``id``, ``is_fraud``), and ln(1 + their mean degree)."""
    both = undirected(edges)
    degree = both.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("_k"))
    known = fraud.groupBy(F.col("id").alias("dst")).agg(F.max(F.col("is_fraud").cast("int")).alias("_f"))
    rows = both.join(degree, "dst").join(known, "dst", "left")
    return rows.groupBy(F.col("src").alias("id")).agg(F.avg(F.coalesce("_f", F.lit(0)).cast("double")).alias("neighbor_fraud_ratio"), F.log1p(F.avg("_k")).alias("hub_proximity"))


def augment(table: DataFrame, key: str, *features: DataFrame) -> DataFrame:
    """A table with the columns of feature tables (``id`` and numbers) appended; 0 for nodes without."""
    for f in features:
        names = [c for c in f.columns if c != "id"]
        table = table.join(f.withColumnRenamed("id", key), key, "left").fillna(0, names)
    return table


def centrality_flags(pagerank: Column, in_degree: Column, between: Column, clustering: Column, core: Column) -> Column:
    """Which centralities of a node are above their limits, or that none is."""
    found = F.array_compact(
        F.array(
            F.when(pagerank > 0.01, F.lit("pagerank")), F.when(in_degree > 0.3, F.lit("in_degree")), F.when(between > 0.05, F.lit("betweenness")),
            F.when(clustering > 0.5, F.lit("clustering")), F.when(core > 0.7, F.lit("k_core")),
        )
    )
    return F.when(F.size(found) == 0, "no_centrality_risk_flags").otherwise(F.array_join(found, ","))


def temporal_levels(df: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``<feature>_level`` for temporal features: HIGH, MEDIUM or LOW by their limits."""
    # Limits above which a feature is high or medium.
    known = limits or {"velocity_ratio": (0.8, 0.5), "burst": (3.0, 1.0), "concentration": (0.7, 0.3), "neighbor_fraud_ratio": (0.3, 0.1)}
    return df.withColumns({f"{c}_level": F.when(F.col(c) > hi, "HIGH").when(F.col(c) > mid, "MEDIUM").otherwise("LOW") for c, (hi, mid) in known.items() if c in df.columns})
