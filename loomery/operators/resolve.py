"""Entity resolution, label quality, synthetic rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators.blocks import BLOCK_ROWS
from loomery.operators.text import jaccard, trigrams


def blocking_key(columns: list[Column], size: int = 3) -> Column:
    """The first characters of each lower-cased, trimmed value, joined; missing ones by a name of their own."""
    part = lambda c: F.coalesce(F.nullif(F.substring(F.lower(F.trim(c.cast("string"))), 1, size), F.lit("")), F.lit("__missing__"))
    return F.concat_ws("|", *[part(c) for c in columns])


def similarity(a: Column, b: Column, kind: str, tolerance: float = 0.1) -> Column:
    """Likeness of two values: text (3-gram Jaccard), exact, or numeric with a linear fall after the tolerance."""
    if kind == "text":
        s = jaccard(trigrams(a.cast("string")), trigrams(b.cast("string")))
    elif kind == "exact":
        s = (F.lower(F.trim(a.cast("string"))) == F.lower(F.trim(b.cast("string")))).cast("double")
    else:
        x, y = F.expr("0D") + a.try_cast("double"), F.expr("0D") + b.try_cast("double")
        gap = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-12))
        s = F.coalesce(F.when(gap <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (gap - tolerance) / (4 * tolerance))), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull(), 0.0).otherwise(s)


def resolve(df: DataFrame, key: str, blocks: list[str], fields: dict[str, tuple[str, float]], threshold: float = 0.7, tolerance: float = 0.1) -> DataFrame:
    """Pairs within a block whose weighted mean likeness reaches the threshold; fields null on both sides don't count.

    ``fields``: column to (kind, weight), likeness as in :func:`similarity`. What a single row can do (grams, lower case,
    numbers) is done once for each row. Blocks are cut into parts of about ``BLOCK_ROWS`` rows, and two parts meet in a task,
    so that neither a large block nor few of them leave the work to one task. Only pairs near the threshold leave a task.
    """
    kinds = {c: kind for c, (kind, _) in fields.items()}
    made = []
    for c, kind in kinds.items():
        made.append(F.col(c).isNull().alias(f"n_{c}"))
        made.append((trigrams(F.col(c).cast("string")) if kind == "text" else F.lower(F.trim(F.col(c).cast("string"))) if kind == "exact" else F.expr("0D") + F.col(c).try_cast("double")).alias(f"v_{c}"))
    rows = df.filter(F.col(key).isNotNull()).select(blocking_key([F.col(c) for c in blocks]).alias("_block"), F.col(key).alias("_id"), *made)
    sizes = rows.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_n"))
    meetings = sizes.agg(F.sum(F.col("_n") * (F.col("_n") + 1) / 2)).first()[0]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    parts = rows.join(sizes, "_block").withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n"))).select("*", every.alias("_other"))
    parts = parts.withColumns({"_p": F.least("_own", "_other"), "_q": F.greatest("_own", "_other")}).drop("_n", "_other")
    kind = df.schema[key].dataType.simpleString()

    def near(x: pd.DataFrame, y: pd.DataFrame, c: str) -> np.ndarray:
        a, b = x[f"v_{c}"].to_numpy(), y[f"v_{c}"].to_numpy()
        if kinds[c] == "text":
            return _shared_grams(a, b)
        if kinds[c] == "exact":
            return (a[:, None] == b[None, :]).astype(float)
        u, v = a.astype(float)[:, None], b.astype(float)[None, :]  # nan: no number
        gap = np.abs(u - v) / np.maximum(np.maximum(np.abs(u), np.abs(v)), 1e-12)
        return np.nan_to_num(np.where(gap <= tolerance, 1.0, np.maximum(0.0, 1 - (gap - tolerance) / (4 * tolerance))), nan=0.0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id", ignore_index=True)
        p, q, found = rows["_p"].iloc[0], rows["_q"].iloc[0], []
        left, right = rows[rows["_own"] == p], rows[rows["_own"] == q]
        ids = right["_id"].to_numpy()
        for i in range(0, len(left), 256):
            part = left.iloc[i : i + 256]
            total, weight = np.zeros((len(part), len(right))), np.zeros((len(part), len(right)))
            for c, (_, w) in fields.items():
                u, v = part[f"n_{c}"].to_numpy(bool)[:, None], right[f"n_{c}"].to_numpy(bool)[None, :]
                total += np.where(u | v, 0.0, near(part, right, c)) * w
                weight += np.where(u & v, 0.0, w)
            own = part["_id"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                score = total / weight
                wanted = (weight != 0) & (score >= threshold - 1e-5)
            wanted &= own[:, None] < ids[None, :] if p == q else own[:, None] != ids[None, :]
            at, to = np.nonzero(wanted)
            one, two = own[at], ids[to]
            found.append(pd.DataFrame({"id_a": np.where(one < two, one, two), "id_b": np.where(one < two, two, one), "score": score[at, to]}))
        return pd.concat(found) if found else pd.DataFrame({"id_a": [], "id_b": [], "score": []})

    # as many shuffle partitions as meetings need: the rows are few, and would be put into one task
    met = parts.repartition(int(min(max(meetings or 1, 1), 4096)), "_block", "_p", "_q").groupBy("_block", "_p", "_q").applyInPandas(run, f"id_a {kind}, id_b {kind}, score double")
    return met.withColumn("score", F.round("score", 6)).filter(F.col("score") >= threshold)


def _shared_grams(a: np.ndarray, b: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Jaccard indices of all pairs of two arrays of gram lists, counted by products of their incidence matrices, ``columns`` grams at a time."""
    sets = [[frozenset(g) if g is not None else frozenset() for g in side] for side in (a, b)]
    known = {g: i for i, g in enumerate(set().union(*sets[0]) & set().union(*sets[1]))}
    shared = np.zeros((len(a), len(b)), np.float32)
    cells = []
    for side in sets:
        at = [(i, known[g]) for i, grams in enumerate(side) for g in grams if g in known]
        cells.append(np.array(at, np.int64).reshape(-1, 2))
    for lo in range(0, len(known), columns):
        one, two = (np.zeros((len(side), min(columns, len(known) - lo)), np.float32) for side in sets)
        for m, c in ((one, cells[0]), (two, cells[1])):
            c = c[(c[:, 1] >= lo) & (c[:, 1] < lo + columns)]
            m[c[:, 0], c[:, 1] - lo] = 1
        shared += one @ two.T
    shared = shared.astype(float)
    union = np.array([len(x) for x in sets[0]], float)[:, None] + np.array([len(x) for x in sets[1]], float)[None, :] - shared
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1.0))


def confident_joint(df: DataFrame, key: str, label: str, probs: str) -> DataFrame:
    """Off-diagonal counts: rows of a label whose most likely class over its threshold is another (``label``, ``guess``, ``n``).

    A class's threshold is the mean probability that its own rows give it.
    """
    own = df.groupBy(F.col(label).alias("cls")).agg(F.avg(F.get(F.col(probs), F.col(label).cast("int"))).alias("threshold"))
    long = df.select(F.col(key).alias("_id"), F.col(label).alias("label"), F.posexplode(probs).alias("cls", "p")).join(F.broadcast(own), "cls")
    best = long.filter("p >= threshold").groupBy("_id", "label").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("guess"))
    return best.filter("guess <> label").groupBy("label", "guess").agg(F.count(F.lit(1)).alias("n"))


def label_errors(df: DataFrame, key: str, label: str, probs: str, threshold: DataFrame | None = None) -> DataFrame:
    """Rows whose most likely class is not their label and reaches that class's threshold, with its probability."""
    own = threshold if threshold is not None else df.groupBy(F.col(label).alias("guess")).agg(F.avg(F.get(F.col(probs), F.col(label).cast("int"))).alias("threshold"))
    p = F.array_max(probs)
    rows = df.withColumns({"guess": (F.array_position(probs, p) - 1).cast("int"), "confidence": p})
    found = rows.join(F.broadcast(own), "guess").filter((F.col("guess") != F.col(label)) & (F.col("confidence") >= F.col("threshold")))
    return found.select(key, label, "guess", "confidence", F.when(F.col("confidence") >= 0.9, "confident_disagreement").otherwise("off_diagonal").alias("kind"))


def synthesize(df: DataFrame, numeric: list[str], n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of correlated normals with the table's means, deviations and correlations, clipped to its ranges."""
    stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in numeric for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))], *[F.corr(a, b).alias(f"r_{a}_{b}") for a in numeric for b in numeric]).first()
    r = np.array([[1.0 if a == b else (stats[f"r_{a}_{b}"] or 0.0) for b in numeric] for a in numeric])
    values, vectors = np.linalg.eigh(r)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 1e-8)))
    out = df.sparkSession.range(n).withColumns({f"_z{k}": F.randn(seed + k) for k in range(len(numeric))})
    cols = []
    for i, c in enumerate(numeric):
        z = sum((F.col(f"_z{k}") * float(root[i, k]) for k in range(1, len(numeric))), F.col("_z0") * float(root[i, 0]))
        cols.append(F.greatest(F.lit(float(stats[f"lo_{c}"])), F.least(F.lit(float(stats[f"hi_{c}"])), z * float(stats[f"s_{c}"] or 0.0) + float(stats[f"m_{c}"]))).alias(c))
    return out.select("id", *cols)


def fidelity(real: DataFrame, made: DataFrame, numeric: list[str]) -> DataFrame:
    """Mean over the columns of 1 - (difference of means + of deviations) / (2 deviations)."""
    def moments(df: DataFrame, side: str) -> DataFrame:
        return df.select(*[F.col(c).cast("double") for c in numeric]).unpivot([], numeric, "column", "v").groupBy("column").agg(F.avg("v").alias(f"m_{side}"), F.stddev_samp("v").alias(f"s_{side}"))

    both = moments(real, "a").join(moments(made, "b"), "column")
    part = 1 - (F.abs(F.col("m_a") - F.col("m_b")) + F.abs(F.col("s_a") - F.col("s_b"))) / (2 * F.col("s_a"))
    return both.agg(F.avg(F.greatest(F.lit(0.0), part)).alias("fidelity"))
