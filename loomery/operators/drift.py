"""Distribution drift. Inputs are long tables: ``side`` ('ref' or 'cur'), optional group columns, ``value``.

All measures are aggregations: bounds or quantile edges per group, counts per bin, one sum; kernels are summed by blocks
inside tasks. No values are collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.stats import kolmogorov_p
from loomery.operators.blocks import over_block_pairs
from loomery.operators.ranking import running_sums
from loomery.session import stage_table


def two_sided(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables in long form: ``side``, ``column``, ``value`` (double); nulls are dropped."""
    def one(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.lit(side).alias("side"), *[F.col(c).cast("double") for c in columns]).unpivot("side", columns, "column", "value").filter("value IS NOT NULL")

    return one(ref, "ref").unionByName(one(cur, "cur"))


def counted(long: DataFrame, groups: list[str]) -> DataFrame:
    """A long table with equal values counted, written once: ``groups``, ``value``, ``r`` and ``c``, its rows of either side.

    Rows are in ranges of group and value; ``_range`` is the range's number, which grows with the value in a group. The
    measures below that say so take such a table in place of the long one.
    """
    cells = long.groupBy(*groups, "value").agg(*[n.alias(c) for c, n in zip("rc", sides(long))])
    return stage_table(cells.repartitionByRange(*groups, "value").withColumn("_range", F.spark_partition_id()), "counted")


def sides(long: DataFrame) -> tuple[Column, Column]:
    """How many rows there are of either side, in a long or a counted table."""
    return (F.sum("r"), F.sum("c")) if "side" not in long.columns else (F.count_if(F.col("side") == "ref"), F.count_if(F.col("side") == "cur"))


def joint_bins(long: DataFrame, groups: list[str], bins: int) -> DataFrame:
    """Equal-width bins over the joint range, left-closed, the last right-closed: ``bin``, ``r`` and ``c`` counts, ``nr``, ``nc``. Takes counted tables."""
    w = Window.partitionBy(*groups)
    ref, cur = sides(long)
    bounds = long.groupBy(*groups).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), ref.alias("nr"), cur.alias("nc"))
    placed = long.join(bounds, groups).withColumn("bin", F.least(F.floor((F.col("value") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(*groups, "bin").agg(ref.alias("r"), cur.alias("c"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*groups, "bin"], "left").fillna(0, ["r", "c"]).withColumn("_flat", F.max(F.col("_lo") == F.col("_hi")).over(w))


def psi_equal_width(long: DataFrame, groups: list[str], bins: int = 10, eps: float = 1e-8) -> DataFrame:
    """Population stability index over joint equal-width bins; ``eps`` is added to the shares. Flat groups have 0."""
    p, q = F.col("r") / F.col("nr") + eps, F.col("c") / F.col("nc") + eps
    return joint_bins(long, groups, bins).groupBy(*groups).agg(F.when(F.first("_flat"), 0.0).otherwise(F.sum((q - p) * F.ln(q / p))).alias("psi"))


def psi_quantile(long: DataFrame, groups: list[str], bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """PSI over the reference's quantile bins, equal edges merged; current values outside them fall in no bin."""
    cuts = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = long.filter("side = 'ref'").groupBy(*groups).agg(F.array_distinct(F.percentile("value", cuts)).alias("_e"))
    sizes = long.groupBy(*groups).agg(F.count_if(F.col("side") == "ref").alias("nr"), F.count_if(F.col("side") == "cur").alias("nc"))
    inside = long.join(edges, groups).filter((F.col("value") >= F.element_at("_e", 1)) & (F.col("value") <= F.element_at("_e", -1)))
    placed = inside.withColumn("bin", F.least(F.size(F.filter("_e", lambda e: e <= F.col("value"))), F.size("_e") - 1))
    counts = placed.groupBy(*groups, "bin").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.size("_e") - 1))).select(*groups, "bin")
    p, q = F.col("r") / (F.col("nr") + eps) + eps, F.col("c") / (F.col("nc") + eps) + eps
    return every.join(counts, [*groups, "bin"], "left").fillna(0, ["r", "c"]).join(sizes, groups).groupBy(*groups).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def psi_unit(long: DataFrame, groups: list[str], bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """PSI over bins of [0, 1], values clipped; ``eps`` is added and the shares made to sum to 1 again."""
    bin_ = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))) * bins), F.lit(bins - 1)).cast("int")
    counts = long.groupBy(*groups, bin_.alias("bin")).agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    sizes = counts.groupBy(*groups).agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    every = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [*groups, "bin"], "left").fillna(0, ["r", "c"])
    p, q = (F.col("r") / F.col("nr") + eps) / (1 + bins * eps), (F.col("c") / F.col("nc") + eps) / (1 + bins * eps)
    return every.groupBy(*groups).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def ks_test(long: DataFrame, groups: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: ``ks`` and its asymptotic ``p_value``. Counts per distinct value are accumulated."""
    steps = long.groupBy(*groups, "value").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    w = Window.partitionBy(*groups)
    run = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("r").over(run) / F.sum("r").over(w) - F.sum("c").over(run) / F.sum("c").over(w))
    out = steps.withColumn("_g", gap).groupBy(*groups).agg(F.max("_g").alias("ks"), F.sum("r").alias("_n"), F.sum("c").alias("_m"))
    return out.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("_n"), F.col("_m"))).drop("_n", "_m")


def wasserstein(long: DataFrame, groups: list[str], points: int = 1000) -> DataFrame:
    """Mean distance of ``points`` linear quantiles of both sides; null for groups without values on a side. Takes counted tables.

    Values are counted, and ranks are running sums of the counts, so no task holds a group's values. A cell gives its value
    to the points whose lower or upper rank lies in it.
    """
    cells = (counted(long, groups) if "side" in long.columns else long).filter("value IS NOT NULL")
    ranked = running_sums(cells, groups, "_range", [F.col("value")], {"_br": F.col("r"), "_bc": F.col("c")}, {"_br": "_nr", "_bc": "_nc"})
    last = points - 1

    def held(side: str) -> DataFrame:
        n, first, most = F.col(side), F.col(f"_b{side}"), F.col(f"_n{side}") - 1
        inside = lambda rank: (rank >= first) & (rank < first + n)
        at = lambda i: most * (i / F.lit(last))
        # the points between the ranks next to the cell's, with room for rounding; most cells have none
        guess = lambda rank: F.when(most > 0, rank * F.lit(last) / most)
        low = F.greatest(F.lit(0), F.coalesce(F.ceil(guess(first - 1) - 1e-6), F.lit(0))).cast("int")
        high = F.least(F.lit(last), F.coalesce(F.floor(guess(first + n) + 1e-6), F.lit(last))).cast("int")
        asked = F.filter(F.sequence(low, high), lambda i: inside(F.floor(at(i))) | inside(F.ceil(at(i))))
        own = F.transform(asked, lambda i: F.struct(i.alias("i"), at(i).alias("x"), inside(F.floor(at(i))).alias("l"), inside(F.ceil(at(i))).alias("h")))
        return ranked.filter((n > 0) & (low <= high)).select(*groups, F.lit(side).alias("_s"), "value", F.explode(own).alias("_p"))

    value = lambda which: F.max(F.when(F.col(f"_p.{which}"), F.col("value"))).alias(f"_{which}")
    ends = held("r").unionByName(held("c"))
    q = ends.groupBy(*groups, F.col("_p.i").alias("i"), "_s").agg(F.max("_p.x").alias("_x"), value("l"), value("h"))
    between = F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise((F.ceil("_x") - F.col("_x")) * F.col("_l") + (F.col("_x") - F.floor("_x")) * F.col("_h"))
    pair = q.withColumn("_q", between).groupBy(*groups, "i").agg(*[F.max(F.when(F.col("_s") == s, F.col("_q"))).alias(f"_{s}") for s in "rc"])
    gaps = pair.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.abs(F.col("_r") - F.col("_c")).alias("d")))), lambda s: s["d"]).alias("_d"))
    return gaps.select(*groups, (F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / points).alias("wasserstein"))


def js_divergence(long: DataFrame, groups: list[str], bins: int = 20, eps: float = 1e-10) -> DataFrame:
    """Jensen-Shannon divergence in bits over joint bins, ``eps`` added and renormalised, clipped to [0, 1]. Takes counted tables."""
    p, q = (F.col("r") / F.col("nr") + eps) / (1 + bins * eps), (F.col("c") / F.col("nc") + eps) / (1 + bins * eps)
    m = (p + q) / 2
    total = F.sum(p * F.ln(p / m) + q * F.ln(q / m)) / (2 * F.ln(F.lit(2.0)))
    return joint_bins(long, groups, bins).groupBy(*groups).agg(F.when(F.first("_flat"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).alias("js"))


def chi2(df: DataFrame, side: str, category: str) -> DataFrame:
    """Goodness of fit of the current categories to the reference's shares, cells expected at 1 or more: ``chi2``, ``dof``."""
    cells = df.groupBy(category).agg(F.count_if(F.col(side) == "ref").alias("r"), F.count_if(F.col(side) == "cur").alias("c"))
    w = Window.partitionBy(F.lit(0))
    expected = F.col("r") / F.sum("r").over(w) * F.sum("c").over(w)
    return cells.withColumn("_e", expected).filter("_e >= 1").agg(F.sum(F.pow(F.col("c") - F.col("_e"), 2) / F.col("_e")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


def welch_z(long: DataFrame, groups: list[str]) -> DataFrame:
    """Difference of the means over its standard error, population variances; 0 if the variance vanishes."""
    side = lambda s: F.when(F.col("side") == s, F.col("value"))
    stats = long.groupBy(*groups).agg((F.avg(side("cur")) - F.avg(side("ref"))).alias("_d"), (F.var_pop(side("ref")) / F.count(side("ref")) + F.var_pop(side("cur")) / F.count(side("cur"))).alias("_v"))
    return stats.select(*groups, F.when(F.col("_v") < 1e-12, 0.0).otherwise(F.col("_d") / F.sqrt("_v")).alias("z"))


def severity(value: Column, ladder: list[tuple[float, str]], top: str) -> Column:
    """The name of the first step the value is below, or ``top``."""
    out = None
    for limit, name in ladder:
        out = F.when(value < limit, name) if out is None else out.when(value < limit, name)
    return out.otherwise(top)


def drift_report(long: DataFrame, psi_threshold: float = 0.1, alpha: float = 0.05, key: str = "column") -> DataFrame:
    """PSI, KS and drift flag of each column: drifted if PSI reaches the threshold or the KS p-value is below ``alpha``."""
    both = psi_equal_width(long, [key]).join(ks_test(long, [key]), key)
    return both.withColumns({"drifted": (F.col("psi") >= psi_threshold) | (F.col("p_value") < alpha), "severity": severity(F.col("psi"), [(psi_threshold, "ok"), (2.5 * psi_threshold, "moderate")], "critical")})


def audit_gate(draft: DataFrame, reference: DataFrame | None, value: str, limit: float = 0.2) -> DataFrame:
    """Write-audit-publish: ``psi`` of the draft against the reference, ``published`` if below the limit; without one it passes."""
    if reference is None:
        return draft.agg(F.lit(0.0).alias("psi"), F.lit(True).alias("published"))
    return psi_equal_width(two_sided(reference, draft, [value]), ["column"]).select("psi", (F.col("psi") < limit).alias("published"))


def mmd_rbf(a: DataFrame, b: DataFrame, vector: str, gamma: float, key: str = "id") -> DataFrame:
    """Maximum mean discrepancy (V-statistic) with a Gaussian kernel, over all rows that have a vector.

    The kernel is summed over pairs of blocks inside tasks; the work grows with the square of the rows.
    """
    take = lambda d, s: d.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("k"), F.lit(s).alias("s"))
    both = take(a, 1.0).unionByName(take(b, -1.0))
    sizes = both.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = both.join(F.broadcast(sizes), "s").select("k", "v", (F.col("s") / F.col("n")).alias("w"))  # two rows

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        left, right, u, v, total = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy()), x["w"].to_numpy(), y["w"].to_numpy(), 0.0
        for i in range(0, len(left), 256):
            part = left[i : i + 256]
            d2 = (part * part).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * part @ right.T
            total += float(u[i : i + 256] @ np.exp(-gamma * np.maximum(d2, 0)) @ v)
        return pd.DataFrame({"t": [total]})

    return over_block_pairs(rows, rows, "k", "k", run, "t double").agg(F.greatest(F.lit(0.0), F.sum("t")).alias("mmd"))
