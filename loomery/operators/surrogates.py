"""Local surrogate models: a weighted ridge regression around each row says what moves a model's prediction there."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1] from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 1) / float(1 << 53)


def _normal(*parts: Column) -> Column:
    """A standard normal number from hashes of the parts (Box and Muller), the same in every run of a task."""
    return F.sqrt(-2 * F.ln(_uniform(*parts, F.lit("r")))) * F.cos(2 * math.pi * _uniform(*parts, F.lit("a")))


def perturbed(rows: DataFrame, key: str, features: list[str], n: int, seed: int) -> DataFrame:
    """Each row and ``n`` neighbours of it: ``_i`` (0: the row itself) and the features with normal noise of 0.3 of their size plus 0.1."""
    moved = lambda j, c: F.col(c) + F.when(F.col("_i") == 0, 0.0).otherwise(_normal(F.lit(seed), F.col(key), F.col("_i"), F.lit(j)) * (F.abs(c) * 0.3 + 0.1))
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumns({c: moved(j, c) for j, c in enumerate(features)})


def local_surrogates(
    df: DataFrame, key: str, features: list[str], predict: Callable[[DataFrame], DataFrame], n: int = 500, width: float = 0.75, ridge: float = 1.0, top: int = 8, seed: int = 42
) -> DataFrame:
    """What moves the prediction of each row: a row per key and feature of its ``top`` features by size of contribution.

    ``predict`` adds a column ``prediction`` to rows with the key and the features and keeps their other columns: an
    expression or a fitted model's ``transform``. Around each row, ``n`` neighbours are predicted; features are
    standardised over them, weighted by ``exp(-d2 / width ** 2)`` (``d2``: mean squared distance), and a ridge regression
    with a free intercept is solved.
    Columns: the key, ``prediction``, ``local_prediction`` (0 to 1), ``local_fidelity``, ``intercept``, ``feature``, ``value``,
    ``contribution`` (per unit of the feature), ``direction``, ``position`` (from 1; ties by order of features).

    Keys are unique; no feature is named ``prediction``. Other columns of ``df`` are not read. Rows with a null
    key or feature are left out; no rows give no rows.
    Neighbours of a row are made where the row is and made anew for the second pass, so that only a row's sums are
    shuffled: ``(k + 1) * (k + 4) / 2`` numbers for ``k`` features, whatever ``n``. Systems are solved in batches in tasks.
    """
    k = len(features)
    base = df.select(F.col(key), *[F.col(c).cast("double").alias(c) for c in features]).dropna(subset=[key, *features])
    moments = perturbed(base, key, features, n, seed).groupBy(key).agg(*[f(c).alias(f"_{t}{j}") for j, c in enumerate(features) for t, f in (("m", F.avg), ("s", F.stddev_pop))])
    known = base.join(moments, key).withColumns({f"_o{j}": F.col(c) for j, c in enumerate(features)})
    told = predict(perturbed(known, key, features, n, seed))
    spread = lambda j: F.when(F.col(f"_s{j}") < 1e-8, 1.0).otherwise(F.col(f"_s{j}"))
    z = {f"_z{j}": (F.col(c) - F.col(f"_m{j}")) / spread(j) for j, c in enumerate(features)}
    far = sum((F.pow((F.col(c) - F.col(f"_o{j}")) / spread(j), F.lit(2.0)) for j, c in enumerate(features)), F.lit(0.0)) / max(k, 1)
    rows = told.select(key, "_i", F.col("prediction").cast("double").alias("_y"), F.exp(-far / width**2).alias("_w"), *[c.alias(a) for a, c in z.items()], *[F.col(f"_{t}{j}") for j in range(k) for t in "mso"])
    of = [F.lit(1.0), *[F.col(f"_z{j}") for j in range(k)]]
    sums = {f"a{i}_{j}": F.sum(F.col("_w") * of[i] * of[j]) for i in range(k + 1) for j in range(i, k + 1)}
    sums |= {f"b{i}": F.sum(F.col("_w") * of[i] * F.col("_y")) for i in range(k + 1)}
    keep = {f"{t}{j}": F.first(f"_{t}{j}") for j in range(k) for t in "mso"}
    systems = rows.groupBy(key).agg(F.max(F.when(F.col("_i") == 0, F.col("_y"))).alias("prediction"), *[c.alias(a) for a, c in (sums | keep).items()])
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, prediction double, local_prediction double, local_fidelity double, intercept double, feature string, value double, contribution double, direction string, position int"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.stack([np.stack([b[f"a{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(k + 1)], 1) for i in range(k + 1)], 1)
            right = np.stack([b[f"b{i}"].to_numpy(float) for i in range(k + 1)], 1)
            beta = np.linalg.solve(a + np.diag([0.0] + [ridge] * k), right[:, :, None])[:, :, 0] if len(b) else np.zeros((0, k + 1))
            m, s, o = (np.stack([b[f"{t}{j}"].to_numpy(float) for j in range(k)], 1) for t in "mso")
            s = np.where(s < 1e-8, 1.0, s)
            raw, y = beta[:, 1:] / s, b["prediction"].to_numpy(float)
            local = np.clip(beta[:, 0] + (beta[:, 1:] * (o - m) / s).sum(axis=1), 0.0, 1.0)
            order = np.argsort(-np.abs(raw), axis=1, kind="stable")[:, :top]
            r, at = np.repeat(np.arange(len(b)), order.shape[1]), order.ravel()
            moves = raw[r, at]
            says = np.where(np.abs(moves) < 1e-8, "neutral", np.where(moves > 0, "increases", "decreases"))
            yield pd.DataFrame(
                {
                    key: b[key].to_numpy()[r], "prediction": y[r], "local_prediction": local[r], "local_fidelity": np.clip(1 - np.abs(y - local), 0, 1)[r], "intercept": beta[r, 0],
                    "feature": np.array(features)[at], "value": o[r, at], "contribution": moves, "direction": says, "position": np.tile(np.arange(1, order.shape[1] + 1), len(b)),
                }
            )

    return systems.mapInPandas(solve, out)
