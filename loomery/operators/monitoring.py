"""Decisions on drift: batteries of tests, retraining, alerts, and monitors of predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomery.functions.stats import gamma_q
from loomery.operators import drift
from loomery.operators.recsys import top_k


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Tail of the chi-square distribution; one value for each row of a report."""
    return pd.Series([None if pd.isna(a) or pd.isna(k) else 1.0 if k < 1 else gamma_q(k / 2, a / 2) for a, k in zip(x, dof)])


def chi2_by(long: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: goodness of fit of the current values, as whole numbers, to the reference's shares; cells expected at 1 or more. Takes counted tables."""
    cells = long.groupBy(*groups, F.col("value").cast("long").alias("_v")).agg(*[n.alias(c) for c, n in zip("rc", drift.sides(long))])
    sums = cells.groupBy(*groups).agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    expected = cells.join(sums, groups).withColumn("_e", F.col("r") / F.col("_r") * F.col("_c")).filter("_e >= 1")
    out = expected.groupBy(*groups).agg(F.sum(F.pow(F.col("c") - F.col("_e"), 2) / F.col("_e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    return out.withColumn("p_value", chi2_tail("chi2", "dof"))


def extended_drift(long: DataFrame, kinds: dict[str, str] | None = None, bins: int = 20, key: str = "column") -> DataFrame:
    """Per column of a long table: Wasserstein and Jensen-Shannon for continuous ones, chi-square and Jensen-Shannon for others.

    Without a kind given a column of 20 different reference values or fewer is categorical. ``severity`` is the worst of
    the two tests', ``confidence`` the share of them that see drift. Equal values are counted once, and all measures read the counts.
    """
    given = F.create_map(*[F.lit(x) for kv in (kinds or {"": ""}).items() for x in kv])
    cells = drift.counted(long, [key])
    ref = cells.filter("r > 0")
    few = ref.groupBy(key).agg(F.count(F.lit(1)).alias("_d"), F.sum("r").alias("_n"), (F.sum(F.col("value") * F.col("r")) / F.sum(F.when(F.col("value").isNotNull(), F.col("r")))).alias("_mean"))
    kind = F.coalesce(F.try_element_at(given, F.col(key)), F.when(F.col("_d") <= 20, "categorical").otherwise("continuous"))
    typed = few.select(key, kind.alias("feature_type"))
    around = ref.filter("value IS NOT NULL").join(few.select(key, "_mean"), key)
    scale = around.groupBy(key).agg(F.sqrt(F.sum(F.col("r") * F.pow(F.col("value") - F.col("_mean"), 2)) / F.sum("r")).alias("_sd"))
    js = drift.js_divergence(cells, [key], bins).withColumn("js", F.round("js", 6))
    rows = typed.join(scale, key, "left").join(js, key)
    continuous = cells.join(typed.filter("feature_type = 'continuous'").select(key), key, "left_semi")
    other = cells.join(typed.filter("feature_type <> 'continuous'").select(key), key, "left_semi")
    w = drift.wasserstein(continuous, [key]).withColumn("wasserstein", F.round("wasserstein", 6))
    out = rows.join(w, key, "left").join(chi2_by(other, [key]), key, "left")
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    # severities as numbers: 0 ok, 1 moderate (or drift, of the chi-square test), 2 critical
    steps = lambda v, a, b: F.when(v < a, 0).when(v < b, 1).otherwise(2)
    first = F.when(F.col("feature_type") == "continuous", steps(F.col("wasserstein") / sd, 0.05, 0.15)).otherwise((F.col("p_value") < 0.05).cast("int"))
    scored = out.withColumns({"_a": first, "_b": steps(F.col("js"), 0.05, 0.10)})
    worst = F.greatest("_a", "_b")
    name = F.when(worst == 0, "ok").when(worst == 2, "critical").when((F.col("_a") == 1) & (F.col("feature_type") != "continuous"), "drift").otherwise("moderate")
    flags = (F.col("_a") > 0).cast("int") + (F.col("_b") > 0).cast("int")
    return scored.select(key, "feature_type", "wasserstein", "js", "chi2", "p_value", name.alias("severity"), (flags / 2).alias("confidence"), (flags > 0).alias("drift_detected"))


def batch_summary(report: DataFrame, key: str = "column") -> DataFrame:
    """One row for a battery of tests: columns checked, with drift, and the critical ones."""
    return report.agg(
        F.count(F.lit(1)).alias("columns_checked"), F.count_if("drift_detected").alias("columns_with_drift"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == "critical", F.col(key)))), ",").alias("critical_columns"), F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("overall_drift"),
    )


def retraining_decision(psi: DataFrame, baseline_auc: float, current_auc: float | None, key: str = "column", limit: float = 0.2, delta: float = 0.05) -> DataFrame:
    """One row: whether any feature's ``psi`` reaches the limit, whether the AUC fell by ``delta``, and whether either calls for training."""
    degraded = current_auc is not None and baseline_auc - current_auc >= delta
    row = psi.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("psi") >= limit, F.col(key)))), ",").alias("drifted"))
    drifted = F.col("drifted") != ""
    reason = F.concat_ws("; ", F.when(drifted, "drift"), F.lit("performance") if degraded else F.lit(None).cast("string"))
    return row.select("max_psi", "drifted", drifted.alias("has_drift"), F.lit(degraded).alias("degraded"), (drifted | degraded).alias("retrain"), reason.alias("reason"))


def drift_alert(report: DataFrame, least: str = "warning", key: str = "column") -> DataFrame:
    """An alert from a drift report (``psi``, ``drifted``), if it is at least as severe as asked: by the largest PSI, .1 warning, .25 critical."""
    row = report.agg(
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), F.count(F.lit(1)).alias("columns_checked"), F.count_if("drifted").alias("columns_with_drift"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col(key)))), ",").alias("features"),
    )
    rank = F.when(F.col("max_psi") >= 0.25, 2).when(F.col("max_psi") >= 0.1, 1).otherwise(0)
    names = ["ok", "warning", "critical"]
    return row.withColumn("severity", F.element_at(F.array(*[F.lit(x) for x in names]), rank + 1)).filter(rank >= names.index(least))


# -- predictions -------------------------------------------------------------------------------------------------------
def prediction_stats(df: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """Number, mean, population deviation, extremes and share above .5 of predictions."""
    x = F.col(value)
    return df.groupBy(*groups).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x > 0.5).cast("double")).alias("positive_rate")
    )


def monitor_windows(df: DataFrame, group: str, order: list[str], value: str, reference: int = 200, window: int = 1000) -> DataFrame:
    """A monitor's two windows in long form: the first ``reference`` predictions of a group, once there are so many, and the last ``window``."""
    first = top_k(df, [group], [F.col(c) for c in order], reference)
    enough = first.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= reference).select(group)
    last = top_k(df, [group], [F.desc(c) for c in order], window)
    take = lambda rows, side: rows.select(group, F.lit(side).alias("side"), F.col(value).cast("double").alias("value"))
    return take(first, "ref").unionByName(take(last, "cur")).join(enough, group, "left_semi")


def prediction_drift(windows: DataFrame, group: str, warning: float = 0.1, critical: float = 0.2) -> DataFrame:
    """Per group: PSI on [0, 1], z of the mean, change of the share above .5, and severity; groups of under ten current values have none."""
    side = lambda s, c: F.when(F.col("side") == s, c)
    high = (F.col("value") > 0.5).cast("double")
    rate = windows.groupBy(group).agg(F.count(side("cur", F.col("value"))).alias("_n"), F.abs(F.avg(side("cur", high)) - F.avg(side("ref", high))).alias("rate_delta")).filter("_n >= 10")
    out = rate.join(drift.psi_unit(windows, [group]), group).join(drift.welch_z(windows, [group]), group)
    level = F.when(F.col("psi") >= critical, "critical").when((F.col("psi") >= warning) | (F.abs("z") > 3.0), "warning").otherwise("ok")
    return out.select(group, "psi", "z", "rate_delta", level.alias("severity"), (level != "ok").alias("has_drift"))


# -- kernel test -------------------------------------------------------------------------------------------------------
def median_gamma(a: DataFrame, b: DataFrame, vector: str, key: str = "id", sample: int = 500, seed: int = 7) -> float:
    """Bandwidth of the kernel test: 1 over twice the median squared distance of ``sample`` rows of both, the first by hash.

    The sample is the method's own: a bandwidth, not the statistic, is drawn from it.
    """
    both = a.select(F.col(key).alias("k"), F.col(vector).alias("v")).unionByName(b.select(F.col(key).alias("k"), F.col(vector).alias("v")))
    some = both.filter(F.col("v").isNotNull()).orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(sample)
    x, y = some.alias("x"), F.broadcast(some).alias("y")  # ``sample`` rows
    squared = F.aggregate(F.zip_with("x.v", "y.v", lambda p, q: F.pow(p.cast("double") - q, F.lit(2.0))), F.lit(0.0), lambda s, d: s + d)
    found = x.join(y, F.col("x.k") < F.col("y.k")).agg(F.percentile(squared, 0.5).alias("m")).first()["m"]
    return 1.0 / (2.0 * found) if found else 1.0


def null_distribution(reference: DataFrame, vector: str, gamma: float, splits: int = 50, key: str = "id", seed: int = 11) -> DataFrame:
    """The statistic of ``splits`` seeded halvings of the reference: ``split``, ``mmd``. All rows take part in each."""
    out = None
    for k in range(splits):
        half = F.pmod(F.xxhash64(F.lit(seed + k), F.col(key)), F.lit(2))
        one = drift.mmd_rbf(reference.filter(half == 0), reference.filter(half == 1), vector, gamma, key).select(F.lit(k).alias("split"), "mmd")
        out = one if out is None else out.unionByName(one)
    return out


def kernel_drift(statistic: Column | str, null: DataFrame, observed: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: the observed statistic, the null's ``1 - alpha`` quantile, its p-value, and whether it is drift (then: retrain)."""
    t = observed.select(F.col(statistic).alias("statistic") if isinstance(statistic, str) else statistic.alias("statistic"))
    both = null.crossJoin(F.broadcast(t))  # one row
    return both.groupBy("statistic").agg(F.percentile("mmd", 1 - alpha).alias("threshold"), F.avg((F.col("mmd") >= F.col("statistic")).cast("double")).alias("p_value")).withColumn("retrain", F.col("statistic") > F.col("threshold"))
