"""Survival curves after a Cox regression: baseline hazard, curves and medians of single rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def baseline_hazard(df: DataFrame, duration: str, event: str, log_hazard: str) -> DataFrame:
    """Breslow's cumulative baseline hazard at each event time: ``t``, ``cumulative``, from 0 at time 0.

    Rows are summed by time first; the running sums are over that table of times.
    """
    times = df.groupBy(F.col(duration).cast("double").alias("t")).agg(F.sum(F.exp(F.col(log_hazard))).alias("_w"), F.sum(F.col(event).cast("double")).alias("_d"))
    order = Window.orderBy("t")
    risk = times.withColumn("_r", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))).filter("_d > 0")
    steps = risk.select("t", F.sum(F.col("_d") / F.col("_r")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))
    return df.sparkSession.createDataFrame([(0.0, 0.0)], "t double, cumulative double").unionByName(steps)


def hazard_at(baseline: DataFrame, times: list[float]) -> DataFrame:
    """The cumulative hazard at given times, linear between event times, level after the last: one row each."""
    asked = baseline.sparkSession.createDataFrame([(float(t),) for t in times], "at double")
    spans = baseline.select("t", "cumulative", F.lead("t").over(Window.orderBy("t")).alias("_t2"), F.lead("cumulative").over(Window.orderBy("t")).alias("_c2"))
    inside = (F.col("at") >= F.col("t")) & (F.col("_t2").isNull() | (F.col("at") < F.col("_t2")))
    share = F.coalesce((F.col("at") - F.col("t")) / (F.col("_t2") - F.col("t")), F.lit(0.0))
    found = spans.join(F.broadcast(asked), inside)  # the times asked for
    return asked.join(found.select("at", (F.col("cumulative") + share * (F.coalesce("_c2", "cumulative") - F.col("cumulative"))).alias("hazard")), "at", "left").withColumn("hazard", F.coalesce("hazard", F.lit(0.0)))


def survival_curves(df: DataFrame, key: str, log_hazard: str, baseline: DataFrame, times: list[float]) -> DataFrame:
    """``survival`` of every row at each time: exp(-exp(log hazard) times the baseline's)."""
    at = F.broadcast(hazard_at(baseline, times))  # the times asked for
    return df.select(key, log_hazard).crossJoin(at).select(key, F.col("at").alias("t"), F.exp(-F.exp(F.col(log_hazard)) * F.col("hazard")).alias("survival"))


def median_survival(df: DataFrame, key: str, log_hazard: str, baseline: DataFrame) -> DataFrame:
    """The first event time at which a row's survival is a half or less; null if it never is.

    Rows of one log hazard share the answer, so the distinct ones are looked up: each asks for the least event time whose
    cumulative hazard reaches ln 2 / exp(log hazard). Hazards and thresholds are ordered together, in spans of their logarithm.
    """
    span = lambda c: F.floor(F.log2(F.greatest(c, F.lit(1e-300))) * 64)
    asked = df.select(F.col(log_hazard).alias("_h")).distinct().withColumn("_c", F.lit(math.log(2.0)) / F.exp("_h"))
    known = baseline.filter("t > 0").select("t", F.col("cumulative").alias("_c"))
    both = known.select("_c", "t", F.lit(None).cast("double").alias("_h")).unionByName(asked.select("_c", F.lit(None).cast("double").alias("t"), "_h")).withColumn("_s", span(F.col("_c")))
    firsts = known.groupBy(span(F.col("_c")).alias("_s")).agg(F.min("t").alias("_first"))
    # the first event time of any later span
    every = both.select("_s").distinct().join(firsts, "_s", "left")
    later = every.withColumn("_later", F.min("_first").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1))).select("_s", "_later")
    inside = F.min("t").over(Window.partitionBy("_s").orderBy(F.desc("_c"), F.col("_h").isNull().desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_in", inside).join(later, "_s").filter("_h IS NOT NULL").select("_h", F.coalesce("_in", "_later").alias("median"))
    return df.select(key, F.col(log_hazard).alias("_h")).join(found, "_h", "left").select(key, "median")
