"""Graph operators over edge tables; iterations are joins, written to the shared folder each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.components import connected_components  # noqa: F401
from loomery.session import drop_staged, stage_table


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges ``src``, ``dst`` without loops, repeats and unknown ends."""
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    if nodes is not None:
        e = e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return e


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once in either direction."""
    pair = F.struct(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    once = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(pair.alias("_e")).select("_e.*").distinct()
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return once.select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))))


def packed(both: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges that are there in either direction as lists: nodes ``id`` with numbers ``at`` from 0, lists ``at``, ``near`` of numbers, and how many nodes.

    Both tables are written. A pass over the lists needs no shuffle: what is known of the nodes is sent along as arrays.
    """
    spark = both.sparkSession
    rows = stage_table(both.select(F.col("src").alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("_m")), "nodes")
    of, within = F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1)
    starts, n = [], 0
    for r in rows.groupBy(of).count().orderBy("_part").collect():  # one for each task
        starts.append((r["_part"], n))
        n += r["count"]
    first = F.broadcast(spark.createDataFrame(starts, "_part long, _first long"))
    nodes = stage_table(rows.select("*", of).join(first, "_part").select("id", (F.col("_first") + within).cast("int").alias("at")), "numbered")
    drop_staged(rows)
    edges = both.join(nodes.select(F.col("id").alias("src"), "at"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("at").alias("to")), "dst")
    return nodes, stage_table(edges.groupBy("at").agg(F.collect_list("to").alias("near")), "near"), n


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degrees over the number of other nodes."""
    n = F.broadcast(nodes.agg((F.count(F.lit(1)) - 1).alias("_n")))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_deg"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_deg"))
    both = nodes.select("id").join(into, "id", "left").join(out, "id", "left").fillna(0, ["in_deg", "out_deg"]).crossJoin(n)  # one row
    return both.select("id", "in_deg", "out_deg", F.try_divide("in_deg", "_n").alias("in_centrality"), F.try_divide("out_deg", "_n").alias("out_centrality"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Local clustering coefficients. Edges lead to the end of higher degree; an edge's triangles are what both its ends lead to.

    Only the lists of edges whose upper end leads on are sent, no wedges.
    """
    both = stage_table(undirected(edges), "links")
    deg = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    a, b = deg.select(F.col("id").alias("src"), F.col("k").alias("ks")), deg.select(F.col("id").alias("dst"), F.col("k").alias("kd"))
    up = stage_table(both.join(a, "src").join(b, "dst").filter("ks < kd OR (ks = kd AND src < dst)").select("src", "dst"), "oriented")
    lists = up.groupBy("src").agg(F.collect_list("dst").alias("far"))
    inner = stage_table(up.join(up.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "inner")
    beyond = inner.join(lists.select(F.col("src").alias("dst"), F.col("far").alias("beyond")), "dst")
    ends = inner.select("src").distinct()
    met = beyond.join(lists.join(ends, "src", "left_semi"), "src").select("src", "dst", F.array_intersect("far", "beyond").alias("w")).filter(F.size("w") > 0)
    corner = lambda id_, n: F.struct(id_.alias("id"), n.cast("long").alias("t"))
    each = met.select(F.inline(F.concat(F.array(corner(F.col("src"), F.size("w")), corner(F.col("dst"), F.size("w"))), F.transform("w", lambda x: corner(x, F.lit(1))))))
    corners = each.groupBy("id").agg(F.sum("t").alias("t"))
    out = nodes.select("id").join(deg, "id", "left").join(corners, "id", "left").fillna(0, ["k", "t"])
    return out.select("id", "k", F.col("t").alias("triangles"), F.when(F.col("k") < 2, 0.0).otherwise(2 * F.col("t") / (F.col("k") * (F.col("k") - 1))).alias("clustering"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, write_every: int = 5) -> DataFrame:
    """PageRank by a fixed number of rounds; the mass of nodes without out-edges is spread over all."""
    n = nodes.count()
    links = stage_table(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src"), "links")
    rank = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for r in range(1, rounds + 1):
        kept = rank.join(links, rank["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("k")).alias("_s"))
        dangling = F.broadcast(rank.join(links.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("_d")))
        rank = nodes.select("id").join(kept, "id", "left").crossJoin(dangling).select("id", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("_s", F.lit(0.0)) + F.col("_d") / n)).alias("rank"))  # one row
        if r % write_every == 0:
            rank = stage_table(rank, "rank")
    return rank


#: Nodes of which one number each is sent to the tasks; graphs of more are worked on by joins.
SENT_NODES = 50_000_000


def k_core(edges: DataFrame) -> DataFrame:
    """True coreness of every node with an edge: the greatest number h of neighbours that themselves reach h, from the degree down.

    A node's number falls to the h-index of its neighbours' until none changes, which is the coreness. Numbers are held by
    the driver, 4 bytes a node, and sent to the tasks in each round; the lists of neighbours stay where they are.
    """
    both = stage_table(undirected(edges), "links")
    if both.select("src").distinct().count() > SENT_NODES:
        return _peeled(both)
    nodes, near, n = packed(both)
    core, spark = np.full(n, n, np.int32), both.sparkSession
    while n:
        sent = spark.sparkContext.broadcast(core)
        found = near.mapInArrow(lambda batches, sent=sent: (_h_index(x, sent.value) for x in batches), "at int, core int").toArrow()
        sent.unpersist()
        if not found.num_rows:
            break
        core = core.copy()
        core[found.column("at").to_numpy()] = found.column("core").to_numpy()
    known = spark.sparkContext.broadcast(core)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(known.value[x.column(1).to_numpy()])], names=["id", "core"])

    out = nodes.mapInArrow(name, f"id {nodes.schema['id'].dataType.simpleString()}, core int")
    drop_staged(both, near)
    return out


def _h_index(batch: pa.RecordBatch, known: np.ndarray) -> pa.RecordBatch:
    """Nodes with fewer neighbours of their number than it says, and the number they fall to."""
    at, size, near = batch.column("at").to_numpy(), batch.column("near").value_lengths().to_numpy(), known[batch.column("near").flatten().to_numpy()]
    own, row = known[at], np.repeat(np.arange(len(at)), size)
    low = np.bincount(row, near >= own[row], minlength=len(at)) < own
    some = low[row]
    row, near = row[some], near[some]
    order = np.lexsort((-near, row))
    row, near = row[order], near[order]
    place = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
    fallen = np.bincount(row, near >= place, minlength=len(at)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(at[low]), pa.array(fallen[low])], names=["at", "core"])


def _peeled(left: DataFrame) -> DataFrame:
    """Coreness by joins: nodes below the degree in turn are peeled off, round by round."""
    edges, k, out = left, 1, None
    while True:
        deg = left.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
        low = stage_table(deg.filter(F.col("d") <= k).select(F.col("src").alias("id")), "peeled")
        if low.limit(1).count():
            gone = low.withColumn("core", F.lit(k))
            out = gone if out is None else out.unionByName(gone)
            rest = left.join(low.select(F.col("id").alias("src")), "src", "left_anti").join(low.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
            cut = stage_table(rest, "core")
            # neighbours that lost all their edges at once are of this core too
            lost = left.select("src").distinct().join(low.withColumnRenamed("id", "src"), "src", "left_anti").join(cut.select("src").distinct(), "src", "left_anti")
            out = out.unionByName(lost.select(F.col("src").alias("id"), F.lit(k).alias("core")))
            left = cut
        else:
            least = deg.agg(F.min("d")).first()[0]
            if least is None:
                break
            k = int(least)
    return out.groupBy("id").agg(F.max("core").alias("core")) if out is not None else edges.select(F.col("src").alias("id"), F.lit(0).alias("core")).limit(0)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities by synchronous label propagation: the most frequent label of the neighbours, the least of equals."""
    both = stage_table(undirected(edges), "links")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        labels = stage_table(votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")), "labels")
    return labels


def ring_report(labels: DataFrame, fraud: DataFrame, least: int = 2) -> DataFrame:
    """Communities of ``least`` members or more: size, share of fraud among the labelled, risk level."""
    s = labels.join(fraud, "id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg(F.col("is_fraud").cast("double")).alias("fraud_ratio")).filter(F.col("size") >= least)
    return s.withColumn("risk", F.when(F.col("fraud_ratio") >= 0.3, "high").when(F.col("fraud_ratio") >= 0.1, "medium").otherwise("low"))


def temporal_features(edges: DataFrame, days: int = 30) -> DataFrame:
    """Per node of dated edges (``src``, ``dst``, ``amount``, ``ts`` in days): recent count, burstiness, concentration, recent ratio."""
    ends = edges.select(F.col("src").alias("id"), "amount", "ts").unionByName(edges.select(F.col("dst").alias("id"), "amount", "ts"))
    w = Window.partitionBy("id")
    rows = ends.withColumns({"_last": F.max("ts").over(w), "_gap": F.col("ts") - F.lag("ts").over(w.orderBy("ts", "amount")), "_sum": F.sum("amount").over(w)})
    recent = F.col("ts") >= F.col("_last") - days
    return rows.groupBy("id").agg(
        F.count_if(recent).alias("velocity"), F.when(F.avg("_gap") > 0, F.stddev_pop("_gap") / F.avg("_gap")).otherwise(0.0).alias("burst"),
        F.sum(F.pow(F.col("amount") / F.col("_sum"), 2)).alias("concentration"), F.try_divide(F.avg(F.when(recent, F.col("amount"))), F.avg("amount")).alias("recent_ratio"),
    )


def calibration(df: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error over equal bins of [0, 1], the last closed."""
    cells = df.groupBy(F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(probability) - F.avg(F.col(label).cast("double"))).alias("gap"))
    return cells.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
