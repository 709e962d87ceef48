"""Review findings: risk, routing, and lexical judgement against known issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of severities; words of a comment that names a fix; marks of a failed call.
WEIGHTS = {"critical": 10.0, "major": 4.0, "minor": 1.0, "suggestion": 0.3}
ACTION_WORDS = "should fix change replace use avoid remove add consider refactor switch instead recommend suggest prefer".split()
ERROR_MARKS = ["api_key", "anthropic_api_key", "api key not set", "api_key_missing"]


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def routing_confidence(risk: Column, low: float = 0.5, high: float = 8.0) -> Column:
    """How sure a routing is: from .5 to 1 outwards of the limits, from .5 down to .1 in the middle between them."""
    middle = 0.1 + 0.4 * (F.abs(risk - (low + high) / 2) / max((high - low) / 2, 1e-9))
    above = F.least(F.lit(1.0), 0.5 + 0.5 * (risk - high) / max(high, 1.0))
    return F.when(risk <= low, 0.5 + 0.5 * (1.0 - risk / max(low, 1e-9))).when(risk >= high, above).otherwise(middle)


def route_reviews(comments: DataFrame, review: str, severity: str, category: str, low: float = 0.5, high: float = 8.0) -> DataFrame:
    """Per review: ``risk_score`` (severity weights, at most 100), findings that escalate, ``decision`` and ``confidence``."""
    s, c = F.lower(F.coalesce(F.col(severity), F.lit("suggestion"))), F.lower(F.coalesce(F.col(category), F.lit("")))
    weight = F.lit(0.3)
    for name, w in WEIGHTS.items():
        weight = F.when(s == name, w).otherwise(weight)
    out = comments.groupBy(review).agg(F.least(F.lit(100.0), F.sum(weight)).alias("risk_score"), F.count_if((s == "critical") | (c == "security")).alias("escalations"), F.count(F.lit(1)).alias("n_comments"))
    sure = routing_confidence(F.col("risk_score"), low, high)
    decision = F.when((F.col("escalations") > 0) | (F.col("risk_score") >= high), "auto_reject").when(F.col("risk_score") <= low, "auto_approve").otherwise("human_review")
    return out.withColumns({"decision": decision, "confidence": F.when(F.col("escalations") > 0, F.least(F.lit(1.0), sure + 0.3)).otherwise(sure)})


def lexical_judge(examples: DataFrame, comments: DataFrame, example: str, keywords: str, text: str, severity: str) -> DataFrame:
    """Per example: faithfulness, helpfulness, false positives and overall score of its comments.

    ``examples`` has the example's key and ``keywords`` (array; empty or null for clean code). Comments that only tell of
    a failed call don't count. A clean example without comments is right, one with issues and none is wrong.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    real = comments.filter(~contains_any(low, ERROR_MARKS)).select(example, low.alias("_t"), F.coalesce(F.col(severity), F.lit("")).alias("_s"))
    asked = examples.select(example, F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), lambda k: F.lower(k)).alias("_k"))
    hit = F.exists("_k", lambda k: F.contains(F.col("_t"), k))
    each = asked.join(real, example, "left").groupBy(example, (F.size("_k") == 0).alias("is_clean")).agg(
        F.count("_t").alias("n"), F.count_if(contains_any(F.col("_t"), ACTION_WORDS)).alias("_help"), F.count_if(F.col("_s").isin("critical", "major")).alias("_high"), F.count_if(hit).alias("_hit")
    )
    none = F.col("n") == 0
    faith = F.when(none, F.col("is_clean").cast("double")).when(F.col("is_clean"), 1.0 - F.col("_high") / F.col("n")).otherwise(F.col("_hit") / F.col("n"))
    scored = each.withColumns({"faithfulness": faith, "helpfulness": F.when(none, F.col("is_clean").cast("double")).otherwise(F.col("_help") / F.col("n"))})
    scored = scored.withColumn("false_positive_rate", F.when(none, 0.0).otherwise(1.0 - F.col("faithfulness")))
    overall = 0.4 * F.col("faithfulness") + 0.3 * F.col("helpfulness") + 0.3 * (1.0 - F.col("false_positive_rate"))
    return scored.select(example, "is_clean", "n", "faithfulness", "helpfulness", "false_positive_rate", overall.alias("overall_score"))


def regression_report(verdicts: DataFrame, domain: str, least: float = 0.5) -> DataFrame:
    """Means by domain and of all (null domain), and whether they reach ``least``."""
    mean = lambda c: F.avg(c).alias(c)
    return verdicts.rollup(domain).agg(F.count(F.lit(1)).alias("n"), mean("faithfulness"), mean("helpfulness"), mean("false_positive_rate"), mean("overall_score")).withColumn("passed", F.col("overall_score") >= least)
