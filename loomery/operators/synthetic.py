"""Synthetic tables by a Gaussian copula: the table's own marginals, the correlations of its normal scores.

What is learned is small and comes from whole-table aggregations: quantiles of each numeric column, shares of each
category, shares of nulls, and the correlations of normal scores. Rows are made from hashes of their number, so any
number of tasks makes the same table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Quantiles kept for a column.
KNOTS = 1001
#: Categories of a column that fit the model; more are no categories.
MAX_CATEGORIES = 100_000


@dataclass
class Copula:
    """What a table's synthetic rows are made from."""

    z: np.ndarray  # normal scores of the quantiles
    quantiles: dict[str, np.ndarray]
    root: np.ndarray  # lower triangular; its square is the matrix of correlations
    categories: dict[str, tuple[list, np.ndarray]]  # values, cumulative shares
    null_share: dict[str, float]
    types: dict[str, StructField]
    whole: set[str] = field(default_factory=set)  # numeric columns of whole numbers

    @property
    def correlations(self) -> np.ndarray:
        return self.root @ self.root.T


def z_knots(n: int) -> np.ndarray:
    """The normal scores of the least of ``n`` values, of the quantiles, and of the greatest."""
    end = min(0.5 / max(1, n), 0.25 / KNOTS)
    return np.array([NormalDist().inv_cdf(p) for p in (end, *((i + 0.5) / KNOTS for i in range(KNOTS)), 1 - end)])


def nearest_correlations(r: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """The matrix with eigenvalues below ``least`` raised to it, scaled back to a diagonal of ones."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    mended = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    scale = np.sqrt(np.diag(mended))
    return mended / np.outer(scale, scale)


def normal_scores(df: DataFrame, quantiles: dict[str, np.ndarray], z: np.ndarray) -> DataFrame:
    """The columns as normal scores, by their places among the quantiles (the middle one for repeated quantiles); nulls stay null."""
    names = list(quantiles)
    sides = {c: (np.unique(q), q) for c, q in quantiles.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {}
            for c in names:
                v = batch[c].to_numpy(float, na_value=np.nan)
                some, q = sides[c]
                low, high = np.searchsorted(q, some, "left"), np.searchsorted(q, some, "right") - 1
                scores = (z[low] + z[high]) / 2
                out[c] = np.where(np.isnan(v), np.nan, np.interp(v, some, scores))
            yield pd.DataFrame(out).astype(object).where(lambda x: x.notna(), None)

    return df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, ", ".join(f"`{c}` double" for c in names))


def fit_copula(df: DataFrame, numeric: list[str], categorical: list[str] = (), accuracy: int = 100_000, epsilon: float | None = None, seed: int = 1) -> Copula:
    """The model of all rows of ``df``.

    Quantiles are within one part in ``accuracy`` of the rows. With ``epsilon``, each numeric column's quantiles are moved
    by Laplace noise of the mean's sensitivity, (greatest - least) / (rows * epsilon), within the column's range. A
    categorical column with more than ``MAX_CATEGORIES`` values is an error. NaN counts as null. Columns that are all null
    come out null; an empty table makes a model of nulls.
    """
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in numeric], *categorical)
    at = [(i + 0.5) / KNOTS for i in range(KNOTS)]
    stats = clean.agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, [0.0, *at, 1.0], accuracy).alias(f"q{i}") for i, c in enumerate(numeric)], *[F.count(c).alias(f"n{i}") for i, c in enumerate([*numeric, *categorical])]
    ).first()  # one row
    n, rng, quantiles = max(1, stats["n"]), np.random.default_rng(seed), {}
    for i, c in enumerate(numeric):
        if stats[f"n{i}"]:
            q = np.array(stats[f"q{i}"], float)
            noise = rng.laplace(0, (q[-1] - q[0]) / (stats[f"n{i}"] * epsilon)) if epsilon else 0.0
            quantiles[c] = np.clip(q + noise, q[0], q[-1])
    known, z = list(quantiles), z_knots(n)
    r = np.eye(len(known))
    pairs = [(i, j) for i in range(len(known)) for j in range(i)]
    if pairs:
        scores = normal_scores(clean, quantiles, z)
        found = scores.agg(*[F.corr(known[i], known[j]).alias(f"r{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            r[i, j] = r[j, i] = 0.0 if found[f"r{i}_{j}"] is None or np.isnan(found[f"r{i}_{j}"]) else found[f"r{i}_{j}"]
    categories = {}
    for c in categorical:
        rows = clean.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).limit(MAX_CATEGORIES + 1).collect()
        if len(rows) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} values")
        counts = np.array([x["count"] for x in rows], float)
        categories[c] = ([x[c] for x in rows], np.cumsum(counts) / max(1.0, counts.sum()))
    shares = {c: 1 - stats[f"n{i}"] / n for i, c in enumerate([*numeric, *categorical])}
    whole = {c for c in numeric if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")}
    return Copula(z, quantiles, np.linalg.cholesky(nearest_correlations(r)) if known else np.zeros((0, 0)), categories, shares, {c: df.schema[c] for c in [*numeric, *categorical]}, whole)


def uniform(key: Column, stream: int, seed: int) -> Column:
    """A number in (0, 1) from a key: the same wherever it is made."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), key), 11).cast("double") + 0.5) / float(1 << 53)


def generate(spark: SparkSession, model: Copula, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows: ``id`` from 0, and the model's columns in their types. Normals are correlated, then put through each column's quantiles; categories and nulls are drawn by their shares."""
    known = list(model.quantiles)
    columns = [F.col("id")]
    for k in range(len(known)):  # two uniforms make a normal
        columns.append((F.sqrt(-2 * F.log(uniform(F.col("id"), 2 * k, seed))) * F.cos(2 * np.pi * uniform(F.col("id"), 2 * k + 1, seed))).alias(f"e{k}"))
    names = list(model.types)
    for i, _ in enumerate(names):
        columns += [uniform(F.col("id"), 100_000 + i, seed).alias(f"null{i}"), uniform(F.col("id"), 200_000 + i, seed).alias(f"draw{i}")]
    z, root = model.z, model.root
    schema = StructType([spark.range(0).schema["id"], *[StructField(c, f.dataType) for c, f in model.types.items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"id": batch["id"]}
            scores = batch[[f"e{k}" for k in range(len(known))]].to_numpy(float) @ root.T if known else None
            for i, c in enumerate(names):
                gone = batch[f"null{i}"].to_numpy() < model.null_share[c]
                if c in model.categories:
                    values, shares = model.categories[c]
                    place = np.minimum(np.searchsorted(shares, batch[f"draw{i}"].to_numpy(), "right"), max(0, len(values) - 1))
                    made = [None if g or not values else values[p] for p, g in zip(place, gone)]
                elif c in known:
                    v = np.interp(scores[:, known.index(c)], z, model.quantiles[c])
                    made = [None if g else int(round(x)) if c in model.whole else float(x) for x, g in zip(v.tolist(), gone)]
                else:
                    made = [None] * len(batch)
                out[c] = pd.Series(made, dtype=object, index=batch.index)
            yield pd.DataFrame(out)

    return spark.range(n).select(*columns).mapInPandas(run, schema)


def compare(real: DataFrame, made: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """What both tables say, one row each: ``kind`` (mean, deviation, correlation, share, nulls), ``name``, ``real``, ``made``."""

    def side(df: DataFrame, name: str) -> DataFrame:
        x = lambda c: F.col(c).cast("double")
        stats = [F.struct(F.lit("mean").alias("kind"), F.lit(c).alias("name"), F.avg(x(c)).alias("v")) for c in numeric]
        stats += [F.struct(F.lit("deviation").alias("kind"), F.lit(c).alias("name"), F.stddev_pop(x(c)).alias("v")) for c in numeric]
        stats += [F.struct(F.lit("correlation").alias("kind"), F.lit(f"{a}, {b}").alias("name"), F.corr(x(a), x(b)).alias("v")) for i, a in enumerate(numeric) for b in numeric[:i]]
        stats += [F.struct(F.lit("nulls").alias("kind"), F.lit(c).alias("name"), F.avg(F.col(c).isNull().cast("double")).alias("v")) for c in [*numeric, *categorical]]
        out = df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.kind", "s.name", F.col("s.v").alias(name))
        for c in categorical:
            counts = df.filter(F.col(c).isNotNull()).groupBy(c).count()
            shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("all"))))  # one row
            out = out.unionByName(shares.select(F.lit("share").alias("kind"), F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("name"), (F.col("count") / F.col("all")).alias(name)))
        return out

    return side(real, "real").join(side(made, "made"), ["kind", "name"], "full_outer")
