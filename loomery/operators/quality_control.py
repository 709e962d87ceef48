"""Lineage, service levels and statistical process control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.session import stage_table


def lineage_edges(events: DataFrame) -> DataFrame:
    """Edges source -> target of START and COMPLETE events (``job``, ``event_type``, ``inputs``, ``outputs`` arrays), once each."""
    live = events.filter(F.col("event_type").isin("START", "COMPLETE"))
    into = live.select(F.explode("inputs").alias("src"), F.col("job").alias("dst"))
    return into.unionByName(live.select(F.col("job").alias("src"), F.explode("outputs").alias("dst"))).distinct()


def hops(edges: DataFrame, starts: DataFrame, max_hops: int = 10, reverse: bool = False) -> DataFrame:
    """``id`` and its least number of ``hops`` from any start (one column ``id``), breadth first, written per level."""
    step = edges.select(F.col("dst" if reverse else "src").alias("id"), F.col("src" if reverse else "dst").alias("to")).distinct()
    seen = starts.select("id").distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, max_hops + 1):
        front = stage_table(front.join(step, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k)), "hops")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def burn_rates(df: DataFrame, service: str, good: Column, ts: str, as_of: Column, target: float, windows: tuple = (1, 6, 72)) -> DataFrame:
    """Per service: error rate over the budget in each trailing window of hours, consumed budget, first alert that fires."""
    rows = df.select(F.col(service).alias("service"), good.cast("double").alias("_g"), F.col(ts).alias("_t"), as_of.alias("_now"))
    budget = 1.0 - target

    def rate(h: int) -> Column:
        inside = F.col("_t") > F.col("_now") - F.make_interval(hours=F.lit(h))
        return F.coalesce(F.avg(F.when(inside, 1.0 - F.col("_g"))), F.lit(0.0))

    out = rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"), *[(rate(h) / budget).alias(f"burn_{h}h") for h in windows], F.avg(1.0 - F.col("_g")).alias("error_rate"))
    # Burn rate limits of the three windows.
    alert = F.when(F.col(f"burn_{windows[0]}h") >= 14.4, "page_fast").when(F.col(f"burn_{windows[1]}h") >= 6.0, "page_slow").when(F.col(f"burn_{windows[2]}h") >= 3.0, "ticket").otherwise("ok")
    return out.withColumns({"consumed": F.least(F.lit(budget), F.col("error_rate")), "compliant_raw": F.col("error_rate") <= budget, "alert": alert})


def shewhart(df: DataFrame, groups: list[str], order: str, value: str, mean: Column, std: Column) -> DataFrame:
    """Control chart with the Western Electric rules; of several the first by number, 0 for none."""
    w = Window.partitionBy(*groups).orderBy(order)
    rows = df.withColumn("z", (F.col(value) - mean) / std)

    def runs(test: Column, need: int, last: int) -> Column:
        frame = w.rowsBetween(-(last - 1), 0)
        return (F.count(F.lit(1)).over(frame) == last) & (F.sum(test.cast("int")).over(frame) >= need)

    z = F.col("z")
    rule = (
        F.when(F.abs(z) > 3, 1)
        .when(runs(z > 2, 2, 3) | runs(z < -2, 2, 3), 2)
        .when(runs(z > 1, 4, 5) | runs(z < -1, 4, 5), 3)
        .when(runs(z > 0, 8, 8) | runs(z < 0, 8, 8), 4)
        .otherwise(0)
    )
    return rows.withColumn("rule", rule)
