"""Experiments, survival, fairness, finance and risk scores, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions.stats import chi2_sf_1
from loomery.operators.ranking import descending_bucket, running_sums
from loomery.session import stage_table


def bucket(id_: Column) -> Column:
    """A number in [0, 1] from the first four bytes of the id's md5."""
    return F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("double") / 4294967295.0


def route(id_: Column, variants: list[tuple[str, float]]) -> Column:
    """The variant whose interval of cumulative weights holds the id's bucket."""
    out, upto = None, 0.0
    for name, weight in variants[:-1]:
        upto += weight
        test = bucket(id_) < upto
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(variants[-1][0]) if out is None else out.otherwise(variants[-1][0])


def variant_stats(df: DataFrame, variant: str, probability: str, outcome: str, high: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(variant).alias("variant")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(probability), 4).alias("mean_prob"),
        F.round(F.avg((F.col(probability) >= high).cast("double")), 4).alias("high_risk_rate"), F.round(F.avg(F.col(outcome).cast("double")), 4).alias("outcome_rate"),
    )


def two_proportions(n1: Column, x1: Column, n2: Column, x2: Column) -> tuple[Column, Column]:
    """Chi-square of a 2x2 table without correction, and its p-value; null if a cell is below 5 or a side below 10."""
    a, b, c, d = x1, n1 - x1, x2, n2 - x2
    ok = (F.least(a, b, c, d) >= 5) & (n1 >= 10) & (n2 >= 10)
    stat = F.when(ok, (n1 + n2) * F.pow(a * d - b * c, 2) / (n1 * n2 * (a + c) * (b + d)))
    return stat, chi2_sf_1(stat)


def kaplan_meier(df: DataFrame, duration: str, event: str, groups: list[str] | None = None) -> DataFrame:
    """Survival by time: at risk, events, S(t), Greenwood variance. Times are grouped first; windows run over times."""
    groups = groups or []
    times = df.groupBy(*groups, F.col(duration).alias("t")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(event).cast("long")).alias("events"))
    w = Window.partitionBy(*groups).orderBy("t") if groups else Window.partitionBy(F.lit(0)).orderBy("t")
    risk = times.withColumn("at_risk", F.sum("_n").over(w.rowsBetween(0, Window.unboundedFollowing)))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("events") / F.col("at_risk")
    gone = F.max((left <= 0).cast("int")).over(past) == 1
    steps = risk.filter("events > 0").withColumn("survival", F.when(gone, 0.0).otherwise(F.exp(F.sum(F.when(left > 0, F.ln(left))).over(past))))
    var = F.sum(F.when(F.col("at_risk") > F.col("events"), F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events"))))).over(past)
    return steps.withColumn("variance", F.col("survival") * F.col("survival") * F.coalesce(var, F.lit(0.0))).drop("_n")


def log_rank(df: DataFrame, duration: str, event: str, group: str, a: object) -> DataFrame:
    """Two-group log-rank test: ``observed``, ``expected`` of group ``a``, ``chi2`` and ``p_value``."""
    times = df.groupBy(F.col(duration).alias("t")).agg(
        F.count_if(F.col(group) == a).alias("na"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(group) == a, F.col(event).cast("long")).otherwise(0)).alias("da"), F.sum(F.col(event).cast("long")).alias("d")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    r = times.withColumns({"ra": F.sum("na").over(w), "r": F.sum("n").over(w)}).filter("d > 0")
    r = r.withColumns({c: F.col(c).cast("double") for c in ("d", "ra", "r")})  # products of four counts, beyond 64 bits from some 100000 rows on
    e = F.col("d") * F.col("ra") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * F.col("ra") * (F.col("r") - F.col("ra")) * (F.col("r") - F.col("d")) / (F.col("r") * F.col("r") * (F.col("r") - 1))).otherwise(0.0)
    out = r.agg(F.sum("da").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("_v"))
    chi = F.pow(F.col("observed") - F.col("expected"), 2) / F.col("_v")
    return out.select("observed", "expected", chi.alias("chi2"), chi2_sf_1(chi).alias("p_value"))


def concordance(df: DataFrame, risk: str, duration: str, event: str, blocks: int = 64) -> DataFrame:
    """Harrell's index: pairs with T_j > T_i and an event at i; equal risks count a half.

    Rows are counted by time and risk; risks, in order, are dealt into ``blocks`` of about equally many. For each event
    cell, later cells of lower blocks come as running sums over times, block by block; only cells of its own block are
    compared one by one, and these in turn by running sums over risks within one time span. So nothing grows with the
    square of the rows: it is a count of inversions by merging, ``log(rows)`` levels deep.
    """
    cells = df.groupBy(F.col(risk).cast("double").alias("r"), F.col(duration).cast("double").alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count(F.lit(1)).alias("n"))
    ranked = _dense(_dense(stage_table(cells, "concordance"), "r", "ri"), "t", "ti").select("ri", "ti", "d", "n")
    ranked = stage_table(ranked, "concordance")
    most = ranked.agg(F.coalesce(F.max("ti"), F.lit(0)).alias("m")).first()["m"]
    levels = max(1, int(most).bit_length())
    # level k: times in spans of 2**(k+1), halves of 2**k; a pair with T_j > T_i meets in exactly one level, i left, j right
    span = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("k")
    spread = ranked.select("*", span).withColumns({"g": F.expr("shiftright(ti, k + 1)"), "right": F.expr("shiftright(ti, k) & 1") == 1})
    by_risk = spread.groupBy("k", "g", "ri").agg(F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("later"), F.sum(F.when(~F.col("right"), F.col("d")).otherwise(0)).alias("events"))
    by_risk = by_risk.withColumn("bucket", F.expr(f"ri div {blocks}"))
    run = running_sums(by_risk, ["k", "g"], "bucket", [F.col("ri")], {"below": F.col("later")}, {"below": "all"})
    hit = F.col("events") * (F.col("below") + F.col("later") / 2)
    pairs = F.sum(F.col("events") * F.col("all"))
    return run.agg((F.sum(hit) / pairs).alias("c_index"), pairs.cast("long").alias("pairs"))


def _dense(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the dense rank (from 0) of a column's values; the values are counted first and ranked in buckets."""
    values = descending_bucket(df.select(value).distinct(), value).withColumn("_all", F.lit(0))
    ranked = running_sums(values, ["_all"], "_bucket", [F.desc(value)], {"_down": F.lit(1).cast("long")}, {"_down": "_n"})
    return df.join(ranked.select(value, (F.col("_n") - 1 - F.col("_down")).alias(out)), value)


def group_metrics(df: DataFrame, group: str, y: str, pred: str) -> DataFrame:
    """Per group: positive rate, TPR, FPR and precision; null where undefined."""
    hit = F.col(pred).cast("double")
    return df.groupBy(F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("positive_rate"), F.avg(F.when(F.col(y) == 1, hit)).alias("tpr"),
        F.avg(F.when(F.col(y) == 0, hit)).alias("fpr"), F.avg(F.when(F.col(pred) == 1, F.col(y).cast("double"))).alias("ppv"),
    )


def fairness_gaps(metrics: DataFrame) -> DataFrame:
    """Gaps between each two groups: parity, opportunity, odds, impact ratio and severity."""
    a, b = metrics.alias("a"), metrics.alias("b")
    gap = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    di = F.least("a.positive_rate", "b.positive_rate") / F.greatest("a.positive_rate", "b.positive_rate")
    out = a.join(b, F.col("a.grp") < F.col("b.grp")).select(
        F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b"), gap("positive_rate").alias("dp"), gap("tpr").alias("eo"), F.greatest(gap("tpr"), gap("fpr")).alias("eodds"), gap("ppv").alias("pp"), di.alias("di")
    )
    return out.withColumn("severity", F.when((F.col("di") < 0.8) | (F.col("eo") > 0.1), "high").when((F.col("di") < 0.9) | (F.col("eo") > 0.05), "medium").otherwise("low"))


def qini(df: DataFrame, score: str, y: str, treated: str, key: str) -> DataFrame:
    """Qini curve: after each row by falling score, treated outcomes less the control's, scaled to the treated.

    Rows are ordered in buckets of scores; only the buckets' sums meet in one task.
    """
    t, o = F.col(treated).cast("long"), F.col(y).cast("long")
    rows = descending_bucket(df.withColumns({"_t": t, "_yt": t * o, "_yc": (1 - t) * o, "_all": F.lit(0)}), score)
    run = running_sums(rows, ["_all"], "_bucket", [F.desc_nulls_last(score), F.col(key)], {"_i": F.lit(1).cast("long"), "_nt": F.col("_t"), "_st": F.col("_yt"), "_sc": F.col("_yc")})
    i, nt, yt, yc = F.col("_i") + 1, F.col("_nt") + F.col("_t"), F.col("_st") + F.col("_yt"), F.col("_sc") + F.col("_yc")
    return run.select(key, i.cast("int").alias("rank"), (yt - F.when(i > nt, yc * nt / (i - nt)).otherwise(0.0)).alias("qini"))


def latency(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    p = lambda q: F.percentile(F.col(column), q)
    return df.groupBy(*groups).agg(F.count(column).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.avg(column).alias("mean"), F.max(column).alias("max"))


# -- finance -------------------------------------------------------------------------------------------------------
def annuity(loan: Column, yearly_rate: float, years: int) -> Column:
    """Monthly payment of an annuity loan."""
    r, n = yearly_rate / 12, years * 12
    return loan / n if r == 0 else loan * r * (1 + r) ** n / ((1 + r) ** n - 1)


def mortgage(df: DataFrame, price: str, down: float = 0.2, rate: float = 0.12, years: int = 20) -> DataFrame:
    loan = F.col(price) * (1 - down)
    pay = annuity(loan, rate, years)
    return df.withColumns({"loan": loan, "monthly": pay, "total_paid": pay * years * 12, "overpayment": pay * years * 12 - loan, "ltv": F.lit(1 - down)})


def rental_yield(price: Column, rent: Column, expenses: float = 0.25) -> dict[str, Column]:
    gross, net = rent * 12 / price, rent * 12 * (1 - expenses) / price
    return {"gross_yield": gross, "net_yield": net, "payback_years": F.when(net > 0, 1 / net)}


def affordability(payment: Column, yearly_income: Column) -> Column:
    """Share of income that the payment takes, as a level: 28 % and 36 % are the usual limits, 43 % the last."""
    share = payment * 12 / yearly_income
    return F.when(share <= 0.28, "comfortable").when(share <= 0.43, "stretched").otherwise("unaffordable")


# -- risk heuristics: weights and cut points are fixed values that results must share ---------------------------------
def churn_probability(tenure: Column, monthly: Column, contract_risk: Column, internet_risk: Column) -> Column:
    loyal = F.when(tenure <= 0, 1.0).when(tenure <= 12, 1.0 - tenure / 24.0).otherwise(F.greatest(F.lit(0.0), 0.5 - (tenure - 12) / 120.0))
    charge = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (monthly - 18.0) / 100.0))
    score = 0.32 * contract_risk + 0.28 * loyal + 0.24 * charge + 0.16 * internet_risk
    return F.least(F.lit(0.96), F.greatest(F.lit(0.04), score))


def fraud_probability(amount: Column, n: Column, age_days: Column) -> Column:
    low, high = F.log1p(F.exp(F.lit(5.32))), F.log1p(F.exp(F.lit(9.125)))
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    size = unit((F.log1p(amount) - low) / (high - low))
    young = F.when(age_days <= 0, 1.0).otherwise(unit(1.0 - F.log1p(age_days) / F.log1p(F.lit(365.0))))
    score = 0.45 * size + 0.30 * young + 0.25 * unit((n - 5) / 25.0)
    return F.least(F.lit(0.97), F.greatest(F.lit(0.03), score))


def risk_action(fraud: Column, churn: Column, anomaly: Column, review: float = 0.70) -> tuple[Column, Column]:
    """Combined score, and the action: block, review, intervene, monitor or ok, the first that applies."""
    combined = 0.55 * fraud + 0.30 * churn + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), anomaly / 3.0))
    action = F.when(fraud >= 0.5, "block").when(combined >= review, "review").when(churn >= 0.5, "intervene").when(anomaly > 3.0, "monitor").otherwise("ok")
    return combined, action
