"""Security audit of a training table and of what its model's service says, as rows of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.profile import iqr_outlier_ratio, label_entropy

# Limits and words of the checks.
OUTLIERS, ENTROPY, DISTINCT, MISSING = 0.15, 0.3, 0.95, 0.3
INTERNAL = ["logit", "embedding", "hidden", "raw_score", "feature_vector", "internal"]
INTEGRITY = ["signature", "hash", "token", "hmac", "digest"]
FINDING = "risk string, severity string, affected string"


def input_manipulation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns with over 15 % of values outside of 1.5 interquartile ranges."""
    each = [iqr_outlier_ratio(df.select(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")), "x", ["c"]) for c in columns]
    bad = reduce(DataFrame.unionByName, each).filter(F.col("outlier_ratio") > OUTLIERS)
    return _found(bad.agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("affected")), "input_manipulation", "high")


def data_poisoning(df: DataFrame, label: str) -> DataFrame:
    """A label whose entropy, over that of equal shares, is below .3."""
    return label_entropy(df, label).filter(F.col("entropy") < ENTROPY).select(F.lit("data_poisoning").alias("risk"), F.lit("high").alias("severity"), F.lit("label").alias("affected"))


def membership_inference(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with over 95 % different values (as text; null is one)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("None"))) / F.count(F.lit(1))).alias(c) for c in columns])
    return _over(row, columns, DISTINCT, "membership_inference", "medium")


def model_skewing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with over 30 % nulls or blanks."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("double")).alias(c) for c in columns])
    return _over(row, columns, MISSING, "model_skewing", "low")


def model_inversion(df: DataFrame, output_fields: list[str]) -> DataFrame:
    """Output fields that show what is inside of a model."""
    risky = [f for f in output_fields if any(w in f.lower() for w in INTERNAL)]
    return df.sparkSession.createDataFrame([("model_inversion", "medium", ",".join(risky))] if risky else [], FINDING)


def model_theft(df: DataFrame, has_rate_limiting: bool, exposes_probabilities: bool) -> DataFrame:
    """No limit on requests; worse if probabilities are given out."""
    return df.sparkSession.createDataFrame([] if has_rate_limiting else [("model_theft", "high" if exposes_probabilities else "medium", "")], FINDING)


def output_integrity(df: DataFrame, output_fields: list[str]) -> DataFrame:
    """No output field that lets a reader check the answer."""
    signed = any(w in " ".join(output_fields).lower() for w in INTEGRITY)
    return df.sparkSession.createDataFrame([] if signed else [("output_integrity", "low", "")], FINDING)


def run_audit(
    df: DataFrame, numeric: list[str], columns: list[str], label: str | None = None, output_fields: list[str] | None = None,
    has_rate_limiting: bool = False, exposes_probabilities: bool = True,
) -> DataFrame:
    """The findings of all seven checks: ``risk``, ``severity``, ``affected``; :func:`profile.audit_score` scores them."""
    fields = output_fields or []
    found = [model_inversion(df, fields), model_theft(df, has_rate_limiting, exposes_probabilities), output_integrity(df, fields)]
    if numeric:
        found.append(input_manipulation(df, numeric))
    if columns:
        found += [membership_inference(df, columns), model_skewing(df, columns)]
    if label is not None:
        found.append(data_poisoning(df, label))
    return reduce(DataFrame.unionByName, found)


def _over(row: DataFrame, columns: list[str], limit: float, risk: str, severity: str) -> DataFrame:
    named = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) > limit, F.lit(c)) for c in columns]))), ",")
    return _found(row.select(named.alias("affected")), risk, severity)


def _found(row: DataFrame, risk: str, severity: str) -> DataFrame:
    return row.filter("affected <> ''").select(F.lit(risk).alias("risk"), F.lit(severity).alias("severity"), "affected")
