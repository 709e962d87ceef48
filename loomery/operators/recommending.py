"""Recommending from factors, bandits and preferences, and offline measures of recommendations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators.blocks import best_dots, by_name, over_slices, places_of, vector_length
from loomery.operators.recsys import cosine, top_k
from loomery.session import stage_table, tasks_for


def factor_recommend(ratings: DataFrame, factors: DataFrame, user: str, item: str, rating: str, vector: str, k: int = 10, places: int = 6) -> DataFrame:
    """The ``k`` best unrated items of each user: user, item, ``score``, ``rank``; ties by item.

    A user's vector is the rating-weighted sum of the factors of its items; scores are dots, rounded to ``places``. Users
    are rows with their ratings, and meet slices of the factors inside tasks: first to sum their vectors, then for their
    best items. Factors are not joined to ratings, and no user is sent to more than one task.
    """
    f = factors.select(F.col(item).alias("i"), F.col(vector).cast("array<double>").alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    rated = ratings.select(F.col(user).alias("q"), F.col(item).alias("i"), F.coalesce(F.col(rating).cast("double"), F.lit(0.0)).alias("w")).filter("q IS NOT NULL AND i IS NOT NULL")
    users = rated.groupBy("q").agg(F.collect_list(F.struct("i", "w")).alias("_r")).select("q", F.col("_r.i").alias("skip"), F.col("_r.w").alias("w"), F.array().cast("array<double>").alias("v"))
    users = stage_table(users, "users")
    n, m = users.count(), f.count()
    spread = users.repartition(max(tasks_for(n * m, 100_000_000), tasks_for(n, 20_000)), "q")
    sums = over_slices(spread, f, "i", 8 + 8 * vector_length(f), by_name, _summed)
    vectors = sums.filter(F.size("v") > 0).select("q", "v", "skip")
    found = best_dots(vectors, f, k, places)
    return found.select(F.col("q").alias(user), F.col("i").alias(item), "score", "rank")


def _summed(batch: pa.RecordBatch, items: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Users' vectors ``v`` with the weighted factors of a slice added; empty until one of the user's items was there."""
    names, factors = items
    row, at, known = places_of(batch.column("skip"), names)
    w = batch.column("w").flatten().to_numpy(zero_copy_only=False)[known]
    has = batch.column("v").value_lengths().to_numpy(zero_copy_only=False) > 0
    total = np.zeros((batch.num_rows, factors.shape[1]))
    total[has] = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, factors.shape[1])
    if len(row):
        own, first = np.unique(row, return_index=True)
        total[own] += np.add.reduceat(w[:, None] * factors[at], first)
        has[own] = True
    ends = np.concatenate([[0], np.cumsum(np.where(has, factors.shape[1], 0))]).astype(np.int32)
    v = pa.ListArray.from_arrays(ends, pa.array(total[has].ravel()))
    return pa.RecordBatch.from_arrays([v.cast(f.type) if f.name == "v" else batch.column(f.name) for f in batch.schema], schema=batch.schema)


def preference_recommend(items: DataFrame, item: str, attributes: list[str], preference: dict[str, str], k: int = 10) -> DataFrame:
    """For a new user: items by the cosine of their one-hot attributes with the preferences named; ties by item."""
    wanted = [F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, v in preference.items() if c in attributes]
    hits = sum(wanted, F.lit(0.0))
    score = hits / (np.sqrt(len(attributes)) * np.sqrt(max(1, len(wanted))))
    return items.select(item, F.round(score, 6).alias("score")).orderBy(F.desc("score"), item).limit(k)


def ranking_measures(recs: DataFrame, test: DataFrame, user: str, item: str, rating: str, k: int = 10, threshold: float = 4.0) -> DataFrame:
    """Precision, recall and nDCG at ``k`` over users with recommendations and relevant test items (rated ``threshold`` or more): one row."""
    relevant = test.filter(F.col(rating) >= threshold).select(user, item).distinct()
    n = relevant.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).join(recs.select(user).distinct(), user, "left_semi")
    hits = recs.filter(F.col("rank") <= k).join(relevant, [user, item], "left_semi").groupBy(user).agg(F.count(F.lit(1)).alias("_h"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("_dcg"))
    each = n.join(hits, user, "left").fillna(0, ["_h", "_dcg"])
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(
        zero(F.col("_h") / k).alias("precision_at_k"), zero(F.col("_h") / F.col("_n")).alias("recall_at_k"), zero(F.col("_dcg") / ideal_dcg(F.least(F.col("_n"), F.lit(k)))).alias("ndcg_at_k"), F.count(F.lit(1)).alias("n_users")
    )


def ideal_dcg(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))


def debias_scores(recs: DataFrame, propensities: DataFrame, user: str, item: str, scale: float = 0.3, floor: float = 1e-4, most: float = 10.0) -> DataFrame:
    """Recommendations scored anew by ``score * min(propensity ** -scale, most)`` and ranked anew; unknown items have the least propensity."""
    p = F.coalesce(F.col("propensity"), F.lit(floor))
    new = recs.join(propensities.select(F.col("item").alias(item), "propensity"), item, "left").withColumn("score", F.col("score") * F.least(F.pow(p, F.lit(-scale)), F.lit(most)))
    return top_k(new.select(user, item, "score"), [user], [F.desc(F.round("score", 9)), F.col(item)], (1 << 31) - 1)


def ips_evaluation(recs: DataFrame, relevant: DataFrame, propensities: DataFrame, user: str, item: str, k: int = 10, floor: float = 1e-4, most: float = 10.0) -> DataFrame:
    """Standard and inverse-propensity nDCG and precision at ``k``, share of the catalogue that is recommended, and how unpopular it is: one row.

    ``propensities`` has ``item``, ``n`` and ``ips_weight``. Users without relevant items don't count, but for the catalogue.
    """
    known = propensities.select(F.col("item").alias(item), "n", "ips_weight")
    least = F.least(F.lit(1 / floor), F.lit(most))
    weight = F.coalesce("ips_weight", least)
    # share of the catalogue with a higher count, from the counts of counts
    counts = known.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    above = counts.alias("a").join(counts.select(F.col("n").alias("m"), F.col("_c").alias("_d")), F.col("m") > F.col("a.n"), "left").groupBy("n").agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("_above"))
    catalogue = known.agg(F.count(F.lit(1)).alias("_items"))
    rel = relevant.select(user, item).distinct()
    top = recs.filter(F.col("rank") <= k).select(user, item, "rank")
    rows = top.join(rel.select(user).distinct(), user, "left_semi").join(rel.withColumn("_rel", F.lit(1)), [user, item], "left").join(known, item, "left").join(above, "n", "left").crossJoin(F.broadcast(catalogue))  # one row
    hit, gain = F.coalesce(F.col("_rel"), F.lit(0)), 1 / F.log2(F.col("rank") + 1.0)
    per = rows.groupBy(user).agg(
        F.sum(hit * gain).alias("_dcg"), F.sum(hit * weight * gain).alias("_idcg"), F.sum(hit).alias("_h"), (F.sum(hit * weight) / F.sum(weight)).alias("_ip"),
        F.sum(F.coalesce("_above", F.col("_items")) / F.col("_items")).alias("_pop"), F.count(F.lit(1)).alias("_recs"),
    )
    best = top_k(rel.join(known, item, "left").withColumn("_w", weight), [user], [F.desc("_w"), F.col(item)], k)
    ideal = best.groupBy(user).agg(F.sum(F.col("_w") / F.log2(F.col("rank") + 1.0)).alias("_best"), F.count(F.lit(1)).alias("_n"))
    each = per.join(ideal, user)
    covered = top.select(item).distinct().agg(F.count(F.lit(1)).alias("_covered"))
    out = each.agg(
        F.avg(F.col("_dcg") / ideal_dcg(F.col("_n"))).alias("ndcg_standard"), F.avg(F.col("_idcg") / F.col("_best")).alias("ndcg_ips"), F.avg(F.col("_h") / k).alias("precision_standard"), F.avg("_ip").alias("precision_ips"),
        (F.sum("_pop") / F.sum("_recs")).alias("popularity_bias"), F.count(F.lit(1)).alias("n_users"),
    )
    return out.crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(catalogue)).withColumn("catalog_coverage", F.col("_covered") / F.col("_items")).drop("_covered", "_items")  # one row each


def diversity(lists: DataFrame, group: str, item: str, vector: str, first: DataFrame) -> DataFrame:
    """Per list: mean pairwise cosine distance, share of sign patterns, distance from the first candidate, entropy of the distances (5 bins of [0, 1]).

    ``lists`` are short ranked lists; ``first`` has each group's most relevant candidate's vector, in a column of the same name.
    """
    a = lists.select(group, F.col(item).alias("i"), F.col(vector).alias("v"))
    pairs = a.join(a.select(group, F.col("i").alias("j"), F.col("v").alias("w")), group).filter("i < j").select(group, (1.0 - cosine(F.col("v"), F.col("w"))).alias("d"))
    mean = pairs.groupBy(group).agg(F.avg("d").alias("_ild"))
    bins = pairs.filter("d >= 0 AND d <= 1").groupBy(group, F.least(F.floor(F.col("d") * 5), F.lit(4)).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.col("_t")
    entropy = bins.join(bins.groupBy(group).agg(F.sum("c").alias("_t")), group).groupBy(group).agg((-F.sum(p * F.log2(p))).alias("_eff"))
    half = F.greatest(F.floor(F.size("v") / 2), F.lit(1)).cast("int")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double"))
    sign = F.struct(F.signum(total(F.slice("v", F.lit(1), half))).cast("int").alias("x"), F.signum(total(F.slice("v", half + 1, F.size("v")))).cast("int").alias("y"))
    own = a.join(first.select(group, F.col(vector).alias("_f")), group).groupBy(group).agg((F.count_distinct(sign) / F.count(F.lit(1))).alias("_cov"), F.avg(1.0 - cosine(F.col("v"), F.col("_f"))).alias("_nov"))
    zero = lambda c: F.round(F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0))), 4)
    return own.join(mean, group, "left").join(entropy, group, "left").select(
        group, zero("_ild").alias("intra_list_diversity"), F.round(F.least(F.lit(1.0), "_cov"), 4).alias("coverage"), zero("_nov").alias("novelty"), zero("_eff").alias("effective_diversity")
    )


def category_embeddings(items: DataFrame, item: str, attributes: dict[str, list[str]], noise: float = 0.05, seed: int = 3) -> DataFrame:
    """Unit vectors of items: one-hot attributes (values given) with seeded noise."""
    cells, k = [], 0
    for c, values in attributes.items():
        for v in values:
            draw = (F.pmod(F.xxhash64(F.lit(seed + k), F.col(item)), F.lit(2001)) - 1000) / 1000.0
            cells.append(F.when(F.col(c) == v, 1.0).otherwise(0.0) + noise * draw)
            k += 1
    raw = F.array(*cells)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return items.select(item, F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("embedding"))


def linucb_recommend(candidates: DataFrame, statistics: DataFrame, arm: str, context: str, alpha: float = 1.0, k: int = 10) -> DataFrame:
    """The ``k`` candidates (``arm``, ``context`` array) of the highest upper bound: ``expected``, ``bonus``, ``ucb``; ties by arm.

    ``statistics`` are the sums of :func:`recsys.linucb_statistics`; an arm without any has the identity. One small matrix
    is inverted per arm, in its task.
    """
    kind = candidates.schema[arm].dataType.simpleString()
    cells = statistics.select(F.col("arm").alias(arm), "i", "j", "a", "b")

    def run(key: tuple, rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({arm: [], "expected": [], "bonus": [], "ucb": []})
        x = np.stack(rows[context].to_numpy()).astype(float)
        d = x.shape[1]
        a, b = np.eye(d), np.zeros(d)
        for i, j, u, v in zip(sums["i"], sums["j"], sums["a"], sums["b"]):
            a[int(i), int(j)] = u
            b[int(i)] += v
        inverse = np.linalg.inv(a)
        expected, bonus = x @ (inverse @ b), alpha * np.sqrt(np.maximum(0.0, np.einsum("ni,ij,nj->n", x, inverse, x)))
        return pd.DataFrame({arm: key[0], "expected": expected.round(6), "bonus": bonus.round(6), "ucb": (expected + bonus).round(6)})

    found = candidates.select(arm, context).groupBy(arm).cogroup(cells.groupBy(arm)).applyInPandas(run, f"`{arm}` {kind}, expected double, bonus double, ucb double")
    return found.orderBy(F.desc("ucb"), arm).limit(k)
