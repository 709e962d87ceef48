"""Models on MLlib and small numpy fits: uplift, calibration, Cox regression, averaging, quantisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.decisions import uplift_segment


def _vectors(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def uplift(df: DataFrame, features: list[str], label: str, treated: str, trees: int = 20, seed: int = 1) -> DataFrame:
    """Two boosted models, of the treated and of the others: ``p_treated``, ``p_control``, ``cate`` and a segment for each row."""
    rows = _vectors(df, features).withColumn("label", F.col(label).cast("double"))
    out = rows
    for name, side in (("p_treated", 1), ("p_control", 0)):
        model = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed).fit(rows.filter(F.col(treated) == side))
        scored = model.transform(out).withColumn(name, F.get(vector_to_array("probability"), 1))
        out = scored.drop("rawPrediction", "probability", "prediction")
    cate = F.col("p_treated") - F.col("p_control")
    segment = uplift_segment(F.col("p_treated"), F.col("p_control"))
    return out.withColumns({"cate": cate, "segment": segment}).drop("features", "label")


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """Add calibrated probabilities by isotonic regression."""
    model = IsotonicRegression(featuresCol=score, labelCol="_y", predictionCol="calibrated").fit(df.withColumns({"_y": F.col(label).cast("double"), score: F.col(score).cast("double")}))
    return model.transform(df.withColumn(score, F.col(score).cast("double")))


def platt(df: DataFrame, score: str, label: str) -> DataFrame:
    """Add calibrated probabilities by a logistic curve."""
    rows = _vectors(df, [score], "_f").withColumn("_y", F.col(label).cast("double"))
    out = LogisticRegression(featuresCol="_f", labelCol="_y").fit(rows).transform(rows)
    return out.withColumn("calibrated", F.get(vector_to_array("probability"), 1)).drop("_f", "_y", "rawPrediction", "probability", "prediction")


def cox(df: DataFrame, features: list[str], duration: str, event: str, steps: int = 25, l2: float = 0.01) -> DataFrame:
    """Cox regression by Newton steps on the Breslow partial likelihood: ``feature``, ``beta`` (standardised features).

    Rows are first summed by time within Spark; risk sets are running sums over the table of times. The driver sees
    one gradient and one small matrix per step.
    """
    k = len(features)
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    z = [(F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(features)]
    rows = df.select(F.col(duration).alias("t"), F.col(event).cast("double").alias("e"), *[x.cast("double").alias(f"z{i}") for i, x in enumerate(z)])
    beta, later = np.zeros(k), Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    for _ in range(steps):
        w = F.exp(sum((F.col(f"z{i}") * float(beta[i]) for i in range(1, k)), F.col("z0") * float(beta[0])))
        first, second = [f"a{i}" for i in range(k)], [f"b{i}_{j}" for i in range(k) for j in range(i, k)]
        times = rows.withColumn("w", w).groupBy("t").agg(
            F.sum("w").alias("w"), F.sum("e").alias("d"), *[F.sum(F.col("w") * F.col(f"z{i}")).alias(f"a{i}") for i in range(k)],
            *[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col("e") * F.col(f"z{i}")).alias(f"x{i}") for i in range(k)],
        )
        run = times.select("d", *[f"x{i}" for i in range(k)], *[F.sum(c).over(later).alias(c) for c in ("w", *first, *second)]).filter("d > 0")
        g = [F.sum(F.col(f"x{i}") - F.col("d") * F.col(f"a{i}") / F.col("w")).alias(f"g{i}") for i in range(k)]
        h = [F.sum(F.col("d") * (F.col(f"b{i}_{j}") / F.col("w") - F.col(f"a{i}") * F.col(f"a{j}") / (F.col("w") * F.col("w")))).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        found = run.agg(*g, *h).first()
        if found["g0"] is None:
            break
        grad = np.array([found[f"g{i}"] for i in range(k)]) - l2 * beta
        hess = np.array([[found[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + l2 * np.eye(k)
        move = np.linalg.solve(hess, grad)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return df.sparkSession.createDataFrame([(c, float(b)) for c, b in zip(features, beta)], "feature string, beta double")


def federated_average(updates: DataFrame, position: str, weight: str, samples: str) -> DataFrame:
    """Sample-weighted mean of each weight of the clients' models."""
    return updates.groupBy(position).agg((F.sum(F.col(weight) * F.col(samples)) / F.sum(samples)).alias("weight"))


def local_updates(df: DataFrame, client: str, features: list[str], label: str, rate: float = 0.1, epochs: int = 5) -> DataFrame:
    """One logistic model per client by gradient steps on its own rows: ``client``, ``position``, ``weight``, ``n``."""
    kind = df.schema[client].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.c_[np.ones(len(rows)), rows[features].to_numpy(float)], rows[label].to_numpy(float)
        w = np.zeros(x.shape[1])
        for _ in range(epochs):
            w -= rate * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
        return pd.DataFrame({"client": key[0], "position": range(len(w)), "weight": w, "n": len(y)})

    return df.select(client, *features, label).groupBy(client).applyInPandas(run, f"client {kind}, position int, weight double, n long")


def quantize(df: DataFrame, weight: str, groups: list[str]) -> DataFrame:
    """Symmetric int8 quantisation of weights per group: ``q``, ``scale`` and the error."""
    scale = df.groupBy(*groups).agg((F.max(F.abs(weight)) / 127).alias("scale"))
    out = df.join(scale, groups).withColumn("q", F.when(F.col("scale") == 0, 0).otherwise(F.round(F.col(weight) / F.col("scale"))).cast("int"))
    return out.withColumn("error", F.col(weight) - F.col("q") * F.col("scale"))


def conformal_interval(df: DataFrame, lo: str, hi: str, y: str, coverage: float = 0.9) -> DataFrame:
    """The widening of predicted intervals that reaches the coverage on calibration rows: ``q_hat``."""
    score = F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi))
    n = df.count()
    level = min(1.0, np.ceil((n + 1) * coverage) / max(n, 1))
    return df.agg(F.percentile(score, float(level)).alias("q_hat"))
