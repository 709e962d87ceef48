"""Several metrics at once: scores, alerts, summaries, and the last points of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators.timeseries import rolling_zscore


def multi_metric(df: DataFrame, groups: list[str], order: list[str], metrics: list[str], window: int = 50, sigma: float = 3.0) -> DataFrame:
    """Rolling scores of each metric (``z_<metric>``) and their largest, ``score``; an anomaly if it is above ``sigma``."""
    out = df
    for m in metrics:
        out = rolling_zscore(out, groups, order, m, window, sigma).withColumnRenamed("score", f"z_{m}").drop("is_anomaly")
    return out.withColumn("score", F.greatest(*[F.col(f"z_{m}") for m in metrics], F.lit(0.0))).withColumn("is_anomaly", F.col("score") > sigma)


def detection_summary(df: DataFrame, groups: list[str], score: str = "score", flag: str = "is_anomaly") -> DataFrame:
    """Points, anomalies and their rate, largest and mean score."""
    hit = F.col(flag).cast("int")
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(hit).cast("long").alias("n_anomalies"), F.avg(hit.cast("double")).alias("anomaly_rate"), F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"), F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score")
    )


def alerts(df: DataFrame, metrics: list[str], threshold: float = 3.0, score: str = "score") -> DataFrame:
    """Points above the threshold: the metric of the largest raw value, that value, and critical from twice the threshold on."""
    values = F.array(*[F.struct(F.abs(F.col(m)).alias("size"), F.lit(-i).alias("at"), F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)])
    worst = F.array_max(values)
    return df.filter(F.col(score) > threshold).withColumns({"metric_name": worst["name"], "metric_value": worst["value"], "severity": F.when(F.col(score) > 2 * threshold, "critical").otherwise("warning")})


def last_zscore(series: Column, window: int = 20, last: int = 5, least: int = 10) -> Column:
    """The largest distance of the last points of an array from the mean of the ``window`` before, in population deviations.

    0 for fewer than ``least`` points; 10 if what came before is flat and a last point isn't on it.
    """
    n = F.size(series)
    end = F.greatest(n - last, F.lit(0))
    start = F.greatest(end - window, F.lit(0))
    ref, now = F.slice(series, start + 1, end - start), F.slice(series, end + 1, n - end)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total(ref) / F.size(ref)
    std = F.sqrt(F.aggregate(ref, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(ref))
    far = F.array_max(F.transform(now, lambda v: F.abs(v - mean)))
    return F.when((n < least) | (end - start < 2), 0.0).when(std == 0, F.when(far > 0, 10.0).otherwise(0.0)).otherwise(far / std)


def snapshot_anomalies(df: DataFrame, metrics: list[str], sigma: float = 3.0) -> DataFrame:
    """Per row of arrays: ``max_score`` (4 places), ``affected`` metrics above ``sigma``, ``is_anomaly``."""
    scored = df.withColumns({f"_z_{m}": last_zscore(F.col(m)) for m in metrics})
    affected = F.array_compact(F.array(*[F.when(F.col(f"_z_{m}") > sigma, F.lit(m)) for m in metrics]))
    out = scored.withColumns({"max_score": F.round(F.greatest(*[F.col(f"_z_{m}") for m in metrics], F.lit(0.0)), 4), "affected": affected})
    return out.withColumn("is_anomaly", F.size("affected") > 0).drop(*[f"_z_{m}" for m in metrics])
