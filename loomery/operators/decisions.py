"""Decisions from experiments and models: tests between variants, uplift, thresholds, comparisons, intervals, costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomery.functions.stats import t_two_sided
from loomery.operators.experiment import annuity, two_proportions
from loomery.operators.ranking import descending_bucket, running_sums

# Prices of instances by the hour, requests a second they are chosen for and can carry.
INSTANCE_PRICES = {"aws_c6i_large": 0.085, "aws_c6i_xlarge": 0.170, "gcp_n2_standard_2": 0.097, "azure_f2s_v2": 0.099}
SMALL_LOAD, SMALL_INSTANCE, LARGE_INSTANCE = 10.0, "aws_c6i_large", "aws_c6i_xlarge"
CAPACITY = 50.0


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-values of Student's t, for the few rows of a report."""
    return pd.Series([None if pd.isna(a) or pd.isna(k) else t_two_sided(a, k) for a, k in zip(t, dof)])


def welch_t(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's test of the means of two groups: ``t``, ``dof``, ``p_value``; nulls under ten values a side."""
    side = lambda g: F.when(F.col(group) == g, F.col(value).cast("double"))
    s = df.agg(*[f(side(g)).alias(f"{n}{k}") for k, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    u, w = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    ok = (F.least("n0", "n1") >= 10) & (u + w > 0)
    t = F.when(ok, (F.col("m0") - F.col("m1")) / F.sqrt(u + w))
    dof = F.when(ok, F.pow(u + w, 2) / (u * u / (F.col("n0") - 1) + w * w / (F.col("n1") - 1)))
    return s.select(t.alias("t"), dof.alias("dof")).withColumn("p_value", t_tail("t", "dof"))


def experiment_decision(df: DataFrame, variant: str, probability: str, control: str, treatment: str, min_samples: int = 385, high: float = 0.5) -> DataFrame:
    """One row for an experiment: its status, p-values of rates and of probabilities, relative effect in percent, winner.

    The rate of probabilities of ``high`` or more decides where its table is large enough, else the probabilities do.
    The winner is the variant of the lower rate.
    """
    side = lambda g, c: F.when(F.col(variant) == g, c)
    hit = (F.col(probability) >= high).cast("double")
    s = df.agg(*[x for k, g in (("c", control), ("t", treatment)) for x in (F.count(side(g, F.lit(1))).alias(f"n_{k}"), F.round(F.avg(side(g, hit)), 4).alias(f"rate_{k}"))])
    x_c, x_t = F.round(F.col("rate_c") * F.col("n_c")), F.round(F.col("rate_t") * F.col("n_t"))
    _, p_rate = two_proportions(F.col("n_c"), x_c, F.col("n_t"), x_t)
    row = s.withColumn("p_value_rate", p_rate).crossJoin(F.broadcast(welch_t(df, variant, probability, control, treatment).select(F.col("p_value").alias("p_value_prob"))))  # one row each
    enough = F.least("n_c", "n_t") >= min_samples
    sure = F.coalesce(F.coalesce("p_value_rate", "p_value_prob") < 0.05, F.lit(False))
    effect = F.when(F.col("rate_c") > 0, F.round((F.col("rate_t") - F.col("rate_c")) / F.col("rate_c") * 100, 2))
    only = lambda c: F.when(enough, c)
    return row.select(
        "n_c", "n_t", "rate_c", "rate_t", F.when(~enough, "not_enough_data").when(sure, "significant").otherwise("inconclusive").alias("status"),
        only(F.col("p_value_rate")).alias("p_value_rate"), only(F.col("p_value_prob")).alias("p_value_prob"), only(effect).alias("relative_effect"),
        F.when(enough & sure, F.when(F.col("rate_t") < F.col("rate_c"), treatment).otherwise(control)).alias("winner"),
    )


# -- uplift ------------------------------------------------------------------------------------------------------------
def uplift_segment(treated: Column, control: Column, least: float = 0.05, churn: float = 0.5) -> Column:
    """Persuadable if treatment lowers the probability by more than ``least``, a sleeping dog if it raises it so; else by the control's."""
    cate = treated - control
    return F.when(cate < -least, "persuadable").when(cate > least, "sleeping_dog").when(control >= churn, "lost_cause").otherwise("sure_thing")


def uplift_summary(df: DataFrame, cate: str, segment: str) -> DataFrame:
    """Rows of each segment, mean effect, and mean effect on the persuadable ones (0 without any)."""
    count = lambda s: F.count_if(F.col(segment) == s).alias(f"n_{s}")
    return df.agg(
        *[count(s) for s in ("persuadable", "sure_thing", "lost_cause", "sleeping_dog")], F.coalesce(F.avg(cate), F.lit(0.0)).alias("avg_cate"),
        F.coalesce(F.avg(F.when(F.col(segment) == "persuadable", F.col(cate))), F.lit(0.0)).alias("targeting_uplift"),
    )


def qini_coefficient(df: DataFrame, score: str, y: str, treated: str, key: str) -> DataFrame:
    """Area between the Qini curve, rows by falling score, and the straight line to its end: ``qini``, ``auuc``, ``random_auuc``.

    The curve after ``i`` of ``n`` rows is treated outcomes over all treated, less control outcomes over all controls times
    ``i / n``. Running counts come from buckets of scores, so no task orders all rows.
    """
    t, o = F.col(treated).cast("long"), F.col(y).cast("long")
    rows = df.select(F.col(key).alias("_key"), F.col(score).alias("_score"), t.alias("_t"), (t * o).alias("_yt"), ((1 - t) * o).alias("_yc"), F.lit(0).alias("_all"))
    rows = descending_bucket(rows, "_score")
    run = running_sums(rows, ["_all"], "_bucket", [F.desc("_score"), F.col("_key")], {"_i": F.lit(1).cast("long"), "_ct": F.col("_yt"), "_cc": F.col("_yc")})
    whole = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"), F.sum("_t").alias("_nt"), F.sum("_yt").alias("_st"), F.sum("_yc").alias("_sc")))  # one row
    both = run.crossJoin(whole)
    nc = F.col("_n") - F.col("_nt")
    at = lambda ct, cc, i: F.when((F.col("_nt") > 0) & (nc > 0), ct / F.col("_nt") - cc / nc * i / F.col("_n")).otherwise(0.0)
    before = at(F.col("_ct"), F.col("_cc"), F.col("_i"))
    after = at(F.col("_ct") + F.col("_yt"), F.col("_cc") + F.col("_yc"), F.col("_i") + 1)
    end = at(F.col("_st"), F.col("_sc"), F.col("_n"))
    out = both.agg((F.sum(before + after) / 2 / F.max("_n")).alias("auuc"), (F.max(end) / 2).alias("random_auuc"))
    return out.select((F.col("auuc") - F.col("random_auuc")).alias("qini"), "auuc", "random_auuc")


# -- models ------------------------------------------------------------------------------------------------------------
def equal_thresholds(df: DataFrame, group: str, y: str, probability: str, metric: str = "equal_opportunity") -> DataFrame:
    """Per group the threshold of .01 to .99 whose true positive rate (or positive rate) is nearest to the mean of all groups and thresholds.

    Rows are counted by group and step of the grid first; the grid is run over these counts.
    """
    grid = F.array(*[F.lit(0.01 + i * 0.98 / 98) for i in range(99)])
    rows = df.filter(F.col(y) == 1) if metric == "equal_opportunity" else df
    cells = rows.select(F.col(group).alias("grp"), F.size(F.filter(grid, lambda t: t <= F.col(probability))).alias("_k")).groupBy("grp", "_k").agg(F.count(F.lit(1)).alias("_c"))
    reached = cells.filter("_k > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_k")))).groupBy("grp", "step").agg(F.sum("_c").alias("_hit"))
    every = df.select(F.col(group).alias("grp")).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(99))))
    rate = every.join(reached, ["grp", "step"], "left").join(cells.groupBy("grp").agg(F.sum("_c").alias("_n")), "grp", "left").select("grp", "step", F.coalesce(F.col("_hit") / F.col("_n"), F.lit(0.0)).alias("rate"))
    target = F.broadcast(rate.agg(F.avg("rate").alias("_target")))  # one row
    gap = F.round(F.abs(F.col("rate") - F.col("_target")), 12)
    return rate.crossJoin(target).groupBy("grp").agg(F.min_by("step", F.struct(gap, F.col("step"))).alias("_s")).select("grp", F.round(F.col("_s") / 100, 2).alias("threshold"))


def binary_metrics(df: DataFrame, groups: list[str], y: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Per group: area under the ROC curve by ranks (ties a half; null with one class), F1, precision and recall at ``threshold``.

    Equal scores are counted first; ranks run over buckets of [0, 1].
    """
    pos, hit = F.col(y).cast("long"), (F.col(probability) >= threshold).cast("long")
    cells = df.groupBy(*groups, F.col(probability).cast("double").alias("_p")).agg(F.sum(pos).alias("_pos"), F.sum(1 - pos).alias("_neg"))
    cells = cells.withColumn("_bucket", F.least(F.greatest(F.floor(F.col("_p") * 1024), F.lit(0)), F.lit(1023)))
    run = running_sums(cells, groups, "_bucket", [F.col("_p")], {"_below": F.col("_neg")})
    area = run.groupBy(*groups).agg(F.try_divide(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)), F.sum("_pos") * F.sum("_neg")).alias("roc_auc"))
    c = df.groupBy(*groups).agg(F.sum(pos * hit).alias("_tp"), F.sum(hit).alias("_pp"), F.sum(pos).alias("_p"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = c.select(*groups, zero(F.try_divide(2 * F.col("_tp"), F.col("_pp") + F.col("_p"))).alias("f1_score"), zero(F.try_divide("_tp", "_pp")).alias("precision"), zero(F.try_divide("_tp", "_p")).alias("recall"))
    return out.join(area, groups)


def leaderboard(metrics: DataFrame, name: str, margin: float = 0.02) -> DataFrame:
    """Models by falling AUC, then F1: ``rank``, and for the first the margin over the second and whether it is significant. A short table."""
    order = Window.orderBy(F.desc("roc_auc"), F.desc("f1_score"), name)
    out = metrics.withColumns({"rank": F.row_number().over(order), "_next": F.lead("roc_auc").over(order)})
    lead = F.when(F.col("rank") == 1, F.coalesce(F.col("roc_auc") - F.col("_next"), F.lit(0.0)))
    return out.withColumn("auc_margin", lead).withColumn("is_significant", F.when(F.col("rank") == 1, F.col("_next").isNull() | (lead >= margin))).drop("_next")


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """R2, RMSE, MAE and MAPE in percent (over values that aren't 0) in one pass."""
    e = F.col(y).cast("double") - F.col(pred)
    return df.agg(
        (1 - F.sum(e * e) / (F.var_pop(F.col(y).cast("double")) * F.count(y))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (100 * F.avg(F.abs(F.try_divide(e, F.col(y).cast("double"))))).alias("mape")
    )


def interval_coverage(df: DataFrame, lo: str, hi: str, y: str, q_hat: float, nominal: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Coverage and mean width of intervals widened by ``q_hat`` on both sides, and whether coverage is near the nominal one."""
    a, b = F.col(lo) - q_hat, F.col(hi) + q_hat
    out = df.agg(F.avg(((F.col(y) >= a) & (F.col(y) <= b)).cast("double")).alias("coverage"), F.avg(b - a).alias("mean_width"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("well_calibrated", F.abs(F.col("coverage") - nominal) <= tolerance)


# -- costs -------------------------------------------------------------------------------------------------------------
def monthly_cost(df: DataFrame, rps: str, instance: str | None = None) -> DataFrame:
    """Instances for a load in requests a second, and what they cost by hour, month and million requests; null for no load."""
    kind = F.when(F.col(rps) <= SMALL_LOAD, SMALL_INSTANCE).otherwise(LARGE_INSTANCE) if instance is None else F.lit(instance)
    price = F.try_element_at(F.create_map(*[F.lit(x) for kv in INSTANCE_PRICES.items() for x in kv]), F.col("instance_type"))
    load = F.when(F.col(rps) > 0, F.col(rps))
    carries = F.when(F.col("instance_type").contains("large"), CAPACITY).otherwise(2 * CAPACITY)
    out = df.withColumn("instance_type", kind).withColumn("n_instances", F.greatest(F.lit(1), F.ceil(load / carries)).cast("int"))
    hour = price * F.when(load.isNotNull(), F.col("n_instances"))
    return out.withColumns(
        {"cost_per_hour": F.round(hour, 4), "cost_per_month": F.round(hour * 720, 2), "cost_per_million": F.round(hour / (load * 3600) * 1_000_000, 4), "near_capacity": load > carries * F.col("n_instances") * 0.8}
    )


def best_batch(df: DataFrame, groups: list[str], batch: str, latency: str, sla: float = 200.0) -> DataFrame:
    """Per group the batch size with the most throughput among those within the limit, the least of equals; if none is, the one with the least latency."""
    ok = F.col(latency) <= sla
    speed = F.col(batch) / F.col(latency)
    pick = df.groupBy(*groups).agg(
        F.count_if(ok).alias("_ok"), F.max_by(F.struct(batch, latency), F.when(ok, F.struct(speed, -F.col(batch)))).alias("_fast"), F.min_by(F.struct(batch, latency), F.struct(F.col(latency), F.col(batch))).alias("_slow")
    )
    chosen = F.when(F.col("_ok") > 0, F.col("_fast")).otherwise(F.col("_slow"))
    return pick.select(*groups, chosen[batch].alias("batch_size"), F.round(chosen[batch] / chosen[latency] * 1000, 2).alias("throughput"), F.round(chosen[latency], 2).alias("latency"), (F.col("_ok") > 0).alias("within_limit"))


def market_rent(df: DataFrame, district: str, area: str, rates: DataFrame, rate: str) -> DataFrame:
    """Add ``rent``: the district's rate times the area; the mean rate for a district that has none."""
    mean = F.broadcast(rates.agg(F.avg(rate).alias("_mean")))  # one row
    return df.join(rates.select(district, F.col(rate).alias("_rate")), district, "left").crossJoin(mean).withColumn("rent", F.coalesce("_rate", "_mean") * F.col(area)).drop("_rate", "_mean")


def investment(df: DataFrame, price: str, rent: str, rate: float = 0.165, years: int = 20, down: float = 0.2, expenses: float = 0.2) -> DataFrame:
    """Add yields, payback, monthly cash flow after the mortgage, months to recover the down payment, and a verdict."""
    p, r = F.col(price).cast("double"), F.col(rent).cast("double")
    net = r * (1 - expenses)
    flow = net - annuity(p * (1 - down), rate, years)
    payback = F.when(net > 0, p / (net * 12))
    verdict = F.when((flow >= 0) & (payback <= 20), "strong_buy").when(payback <= 25, "buy").when(payback <= 35, "hold").otherwise("avoid")
    return df.withColumns(
        {
            "gross_yield_pct": F.when(p > 0, r * 12 / p * 100).otherwise(0.0), "net_yield_pct": F.when(p > 0, net * 12 / p * 100).otherwise(0.0), "payback_years": payback,
            "monthly_cashflow": flow, "recovery_months": F.when(net > 0, p * down / net), "verdict": verdict,
        }
    )
