"""Text classification, synthetic tables, contributions and geo cells against plain versions."""

import math
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import geo, synthetic, text_classifier, timeseries

KINDS = {"bug": "crash error null fails broken".split(), "style": "rename spaces format naming tidy".split(), "speed": "slow cache loop memory query".split()}


def _reviews(spark, n=90):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        kind = sorted(KINDS)[i % 3]
        words = [rng.choice(KINDS[kind] if rng.random() < 0.6 else ["the", "this", "code", "here", "a"]) for _ in range(rng.randrange(3, 12))]
        rows.append((i, " ".join(words), kind if i % 10 else None, "x"))
    rows += [(n, None, "bug", "x"), (n + 1, "", "speed", "x"), (n + 2, "Crash! " * 3000, "bug", "x")]
    return spark.createDataFrame(rows, "i int, text string, kind string, category string").repartition(3)


def test_classifier_is_at_the_optimum_of_its_loss(spark):
    df = _reviews(spark)
    fit = text_classifier.fit_text_classifier(df, "text", "kind", dims=64, stop_words=False)
    assert fit.labels == ["bug", "speed", "style"]
    rows = fit.features.transform(df.filter("kind IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("given"), "kind")).select("hashed", "features", "kind").collect()
    # weights: counts times logarithms of document counts, of length 1
    hashed = np.array([r.hashed.toArray() for r in rows])
    idf = np.log((len(rows) + 1) / ((hashed > 0).sum(axis=0) + 1))
    x = hashed * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    assert np.allclose(x, [r.features.toArray() for r in rows])
    w, b = fit.model.coefficientMatrix.toArray(), fit.model.interceptVector.toArray()
    y = np.eye(3)[[fit.labels.index(r.kind) for r in rows]]
    p = np.exp(x @ w.T + b)
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs((p - y).T @ x + w).max() < 0.02  # the gradient of the summed losses and the penalty
    assert np.abs((p - y).sum(axis=0)).max() < 0.02
    got = {r.i: r for r in fit.classify(df).collect()}
    assert len(got) == 93 and set(got[0].asDict()) == {"i", "text", "kind", "category", "confidence", "probabilities"}
    assert sum(r.category == r.kind for r in got.values() if r.kind) > 0.8 * len(rows)
    assert all(abs(sum(r.probabilities.values()) - 1) < 1e-9 and r.confidence == max(r.probabilities.values()) == r.probabilities[r.category] for r in got.values())
    assert got[90].probabilities == got[91].probabilities  # null as empty
    assert text_classifier.fit_text_classifier(df.filter("kind = 'bug'"), "text", "kind") is None
    assert text_classifier.fit_text_classifier(df.filter("false"), "text", "kind") is None


def test_ranking_quality(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.1, 0.25, 0.5, rng.random()]), int(rng.random() < 0.4)) for _ in range(300)]
    got = text_classifier.ranking_quality(spark.createDataFrame([*rows, (None, 1), (0.3, None)], "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert got.auc == pytest.approx(want) and got.n == 300 and got.positives == len(pos)
    assert got.accuracy == pytest.approx(sum((s > 0.5) == y for s, y in rows) / 300)
    assert text_classifier.ranking_quality(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y").first().auc is None


def test_synthetic_rows_are_like_the_table(spark):
    rng = np.random.default_rng(3)
    n = 6000
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.7, -0.4], [0.7, 1, 0], [-0.4, 0, 1]], n)
    rows = [(float(np.exp(a)), int(round(10 * b)), None if rng.random() < 0.2 else float(c), ["x", "y", None, "zz"][int(k)], 7) for (a, b, c), k in zip(z, rng.choice(4, n, p=[0.5, 0.3, 0.1, 0.1]))]
    df = spark.createDataFrame(rows, "a double, b int, c double, k string, one int").repartition(4)
    model = synthetic.fit_copula(df, ["a", "b", "c"], ["k", "one"])
    made = synthetic.generate(spark, model, n)
    assert [(f.name, f.dataType.simpleString()) for f in made.schema.fields] == [("id", "bigint"), ("a", "double"), ("b", "int"), ("c", "double"), ("k", "string"), ("one", "int")]
    for r in synthetic.compare(df, made, ["a", "b", "c"], ["k", "one"]).collect():
        bound = 0.06 * {"a": 2.0, "b": 10.0, "c": 1.0}[r.name] if r.kind in ("mean", "deviation") else 0.05
        if r.kind == "deviation" and r.name == "a":
            bound = 0.15 * r.real  # a long tail
        if r.name == 'b, a':
            bound = 0.06  # of a long tail
        assert abs(r.real - r.made) < bound, r
    lo, hi = made.agg(F.min("a"), F.max("a")).first()
    assert lo >= min(r[0] for r in rows) and hi <= max(r[0] for r in rows)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, synthetic.generate(spark, model, n).repartition(3).collect()))
    noisy = synthetic.fit_copula(df, ["a"], epsilon=1e-3, seed=5)
    assert not np.allclose(noisy.quantiles["a"], model.quantiles["a"])
    with pytest.raises(ValueError, match="more than"):
        synthetic.MAX_CATEGORIES, kept = 2, synthetic.MAX_CATEGORIES
        try:
            synthetic.fit_copula(df, [], ["k"])
        finally:
            synthetic.MAX_CATEGORIES = kept
    nothing = synthetic.generate(spark, synthetic.fit_copula(df.filter("false"), ["a"], ["k"]), 3).collect()
    assert [(r.a, r.k) for r in nothing] == [(None, None)] * 3


def test_nearest_correlations():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    good = synthetic.nearest_correlations(bad)
    assert np.linalg.eigvalsh(good).min() > 0 and np.allclose(np.diag(good), 1) and np.linalg.eigvalsh(bad).min() < 0
    assert np.allclose(synthetic.nearest_correlations(np.eye(3)), np.eye(3))


def test_contributions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), None if i == 5 else float(c)) for i, (a, b, c) in enumerate(rng.normal(0, 1, (300, 3)))] + [(300, 9.0, 0.0, 0.0), (301, 0.0, 0.0, -8.0)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double").repartition(3)
    got = defaultdict(dict)
    for r in timeseries.isolation_contributions(df, "i", ["a", "b", "c"], n_trees=40).collect():
        got[r.i][r.feature] = (r.score, r.contribution)
    assert len(got) == 302 and all(sum(c for _, c in v.values()) == pytest.approx(1) for v in got.values())
    assert max(got[300], key=lambda f: got[300][f][1]) == "a" and max(got[301], key=lambda f: got[301][f][1]) == "c"
    # plain: one row and one feature at a time
    kept = df.select(F.xxhash64("i").alias("h"), "a", "b", "c").na.drop().orderBy("h").toPandas()
    trees = timeseries.isolation_trees(kept[["a", "b", "c"]].to_numpy(), 40)
    means = [statistics.fmean(r[k] for r in rows if r[k] is not None) for k in (1, 2, 3)]
    for i in (0, 5, 300):
        x = np.array([[means[k] if v is None else v for k, v in enumerate(rows[i][1:])]])
        base, falls = timeseries.isolation_scores(trees, x)[0], []
        for k in range(3):
            y = x.copy()
            y[0, k] = means[k]
            falls.append(max(0.0, base - timeseries.isolation_scores(trees, y)[0]))
        assert got[i]["a"][0] == pytest.approx(base)
        assert [got[i][f][1] for f in "abc"] == pytest.approx([f / sum(falls) if sum(falls) else 1 / 3 for f in falls])


def test_geo_cells(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-0.2, 0.2), rng.uniform(37, 37.3), rng.choice([None, round(rng.uniform(1, 9), 2)])) for i in range(200)] + [(999, None, 1.0, 5.0)]
    got = {r.i: r for r in geo.market_features(spark.createDataFrame(rows, "i int, lat double, lng double, price double"), "lat", "lng", "price").collect()}
    cell = lambda r, step: (int(r[1] / step), int(r[2] / step))  # noqa: E731  toward 0
    for r in rows[:-1]:
        mine = [x[3] for x in rows[:-1] if cell(x, 0.05) == cell(r, 0.05) and x[3] is not None]
        a, b = cell(r, 0.05)
        assert got[r[0]].cell_district == f"r7:{a}:{b}" and got[r[0]].n_prices == len(mine)
        assert got[r[0]].median_price == (pytest.approx(statistics.median(mine)) if mine else None)
        near = [x[3] for x in rows[:-1] if all(abs(u - v) <= 1 for u, v in zip(cell(x, 0.025), cell(r, 0.025))) and x[3] is not None]
        assert got[r[0]].ring_n == len(near) and got[r[0]].ring_mean == (pytest.approx(statistics.fmean(near)) if near else None)
    assert got[999].cell_district is None and got[999].median_price is None
    assert Counter(r.i for r in got.values()).most_common(1)[0][1] == 1
