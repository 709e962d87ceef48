"""Retrieval, local surrogates, shapes of distributions and reports on personal data against plain versions."""

import math
import random
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import stats
from loomery.operators import guards, profile, retrieval, surrogates, text

WORDS = "vacation policy remote work travel expense report manager approval holiday security access data review team".split()


def corpus(spark, n=60):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 25))), "x") for i in range(n)]
    rows += [(n, rows[0][1], "x"), (n + 1, None, "x"), (n + 2, "", "x"), (n + 3, "policy " * 5000, "x")]
    return rows, spark.createDataFrame(rows, "id int, body string, doc string").repartition(5)


QUESTIONS = [(1, "What is the vacation policy?"), (2, "How does travel expense approval work?"), (3, "zzz"), (4, ""), (5, "Explain remote access security")]


def vectors(body):
    c = Counter(re.findall(r"\w+", (body or "").lower()))
    v = {t: 1 + math.log(k) for t, k in c.items()}
    return v, math.sqrt(sum(w * w for w in v.values()))


def plain_near(rows, question, k):
    q, nq = vectors(question)
    out = []
    for i, body, _ in rows:
        d, nd = vectors(body)
        dot = sum(w * d[t] for t, w in q.items() if t in d)
        if dot:
            out.append((-round(dot / (nq * nd), 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def plain_fused(lists, k, c=60):
    score = Counter()
    for ids in lists:
        for at, i in enumerate(ids, 1):
            score[i] += 1 / (c + at)
    return sorted(((-round(s, 6), i) for i, s in score.items()))[:k]


def test_semantic_search(spark):
    rows, docs = corpus(spark)
    asked = spark.createDataFrame(QUESTIONS, "no int, said string")
    found = {}
    for r in retrieval.semantic_search(docs, "id", "body", asked, "no", "said", 7).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append((r.doc, r.similarity))
    for no, said in QUESTIONS:
        want = plain_near(rows, said, 7)
        assert [i for i, _ in found.get(no, [])] == [i for i, _ in want]
        assert np.allclose([s for _, s in found.get(no, [])], [s for _, s in want])


def plain_hybrid(spark, rows, docs, said, k):
    asked = spark.createDataFrame([(0, said)], "no int, said string")
    lexical = [r.doc for r in text.bm25(docs, "id", "body", asked, "no", "said", 2 * k).orderBy("rank").collect()]
    return plain_fused([lexical, [i for i, _ in plain_near(rows, said, 2 * k)]], k)


def test_hybrid_and_multi_query_search(spark):
    rows, docs = corpus(spark)
    asked = spark.createDataFrame(QUESTIONS, "no int, said string")
    found, many = {}, {}
    for r in retrieval.hybrid_search(docs, "id", "body", asked, "no", "said", 5).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append((-r.rrf, r.doc))
    for r in retrieval.multi_query_search(docs, "id", "body", asked, "no", "said", 3).orderBy("query", "rank").collect():
        many.setdefault(r.query, []).append(((-r.rrf, r.doc), r.n_variants, r.consistency))
    forms = {r.no: r.f for r in asked.select("no", retrieval.knowledge.query_variants(F.col("said")).alias("f")).collect()}
    assert forms[1] == ["What is the vacation policy?", "vacation policy", "Explain the vacation policy"]
    for no, said in QUESTIONS[:2]:
        assert found[no] == plain_hybrid(spark, rows, docs, said, 5)
        lists = [[i for _, i in plain_hybrid(spark, rows, docs, f, 6)] for f in forms[no]]
        assert [x[0] for x in many[no]] == plain_fused(lists, 3)
        sets = [set(x[:5]) for x in lists]
        pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
        assert {x[1:] for x in many[no]} == {(len(lists), round(sum(pairs) / len(pairs), 3))}
    assert 3 not in found and 4 not in found and 4 not in many


def test_hypothetical_search(spark):
    rows, docs = corpus(spark)
    asked = spark.createDataFrame(QUESTIONS, "no int, said string")
    got = {}
    for r in retrieval.hypothetical_search(docs, "id", "body", asked, "no", "said", 4).orderBy("query", "rank").collect():
        got.setdefault((r.query, r.hypothesis), []).append(r.doc)
    assert {q for q, _ in got} >= {1, 2, 5}
    for (_, said), ids in got.items():
        assert ids == [i for i, _ in plain_near(rows, said, 4)]


def test_searching_nothing(spark):
    _, docs = corpus(spark)
    asked = spark.createDataFrame(QUESTIONS, "no int, said string")
    for search in (retrieval.semantic_search, retrieval.hybrid_search, retrieval.multi_query_search, retrieval.hypothetical_search):
        assert search(docs.filter("false"), "id", "body", asked, "no", "said").count() == 0
        assert search(docs, "id", "body", asked.filter("false"), "no", "said").count() == 0


def _risk(df):
    return df.withColumn("prediction", 1 / (1 + F.exp(-(F.col("a") * 0.8 - F.col("b") * 0.01 + F.sin("c")))))


def test_local_surrogates_equal_plain_regressions(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.uniform(0, 200), rng.choice([0.0, 1.0, -1.0]), "other") for i in range(12)] + [(50, None, 1.0, 1.0, "x"), (None, 1.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, value string").repartition(4)
    names, n = ["a", "b", "c"], 120
    got = {}
    for r in surrogates.local_surrogates(df, "k", names, _risk, n=n, top=2).orderBy("k", "position").collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(range(12))
    near = surrogates.perturbed(df.filter("k < 12").select("k", *names), "k", names, n, 42)
    x = {k: np.zeros((n + 1, 3)) for k in got}
    y = {k: np.zeros(n + 1) for k in got}
    for r in _risk(near).collect():
        x[r.k][r._i], y[r.k][r._i] = [r.a, r.b, r.c], r.prediction
    noise = np.concatenate([(x[i][1:] - x[i][0]) / (np.abs(x[i][0]) * 0.3 + 0.1) for i in x])
    assert abs(noise.mean()) < 0.06 and abs(noise.std() - 1) < 0.05 and np.abs(np.corrcoef(noise.T) - np.eye(3)).max() < 0.08
    for k, out in got.items():
        m, s = x[k].mean(axis=0), x[k].std(axis=0)
        z = (x[k] - m) / s
        w = np.exp(-((z - z[0]) ** 2).mean(axis=1) / 0.75**2)
        one = np.c_[np.ones(n + 1), z]
        beta = np.linalg.solve(one.T @ (w[:, None] * one) + np.diag([0, 1, 1, 1]), one.T @ (w * y[k]))
        raw = beta[1:] / s
        order = np.argsort(-np.abs(raw), kind="stable")[:2]
        assert [r.feature for r in out] == [names[j] for j in order] and [r.position for r in out] == [1, 2]
        assert np.allclose([r.contribution for r in out], raw[order]) and np.isclose(out[0].intercept, beta[0])
        local = min(1, max(0, beta[0] + beta[1:] @ z[0]))
        assert np.isclose(out[0].local_prediction, local) and np.isclose(out[0].prediction, y[k][0]) and np.isclose(out[0].local_fidelity, 1 - abs(y[k][0] - local))
        assert all(r.direction == ("increases" if r.contribution > 0 else "decreases") for r in out)
    assert surrogates.local_surrogates(df.filter("false"), "k", names, _risk).count() == 0


def test_local_surrogates_know_idle_features(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double")
    out = {r.feature: r for r in surrogates.local_surrogates(df, "k", ["a", "b"], lambda d: d.withColumn("prediction", F.lit(0.25))).collect()}
    assert out["a"].direction == out["b"].direction == "neutral" and out["a"].local_fidelity > 0.999


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.0242, 0.0243, 0.3, 0.5, 0.77, 0.9757, 0.9758, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.normal_quantile(F.col("p")).alias("q")).collect()
    for r in got:
        assert math.isclose(r.q, NormalDist().inv_cdf(r.p), rel_tol=1e-8, abs_tol=1e-8)


def plain_shapiro(values):
    """Royston's algorithm, step by step."""
    x = sorted(values)
    n, q = len(x), NormalDist().inv_cdf
    m = [q((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), n**-0.5
    a = [0.0] * n
    a[-1] = m[-1] / mm**0.5 + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a[-2] = m[-2] / mm**0.5 + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[0], a[1] = -a[-1], -a[-2]
    for i in range(2, n - 2):
        a[i] = m[i] / phi**0.5
    mean = sum(x) / n
    w = sum(c * v for c, v in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    if n <= 11:
        y = -math.log(-2.273 + 0.459 * n - math.log(1 - w))
        mu, sd = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y, k = math.log(1 - w), math.log(n)
        mu, sd = 0.0038915 * k**3 - 0.083751 * k**2 - 0.31082 * k - 1.5861, math.exp(0.0030302 * k**2 - 0.082676 * k - 0.4803)
    return w, 1 - NormalDist().cdf((y - mu) / sd)


def plain_uniform(values):
    x, n = sorted(values), len(values)
    f = [(v - x[0]) / (x[-1] - x[0]) for v in x]
    d = max(max((i + 1) / n - p, p - i / n) for i, p in enumerate(f))
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return d, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 60)))


def _shapes():
    rng = random.Random(11)
    return {
        "normal": [rng.gauss(5, 2) for _ in range(700)], "lognormal": [math.exp(rng.gauss(0, 1)) for _ in range(600)], "uniform": [rng.uniform(-3, 8) for _ in range(500)],
        "other": [rng.choice([rng.gauss(0, 1), rng.gauss(20, 1)]) for _ in range(400)], "categorical": [float(rng.randrange(4)) for _ in range(300)], "too_few_values": [1.0, 2.5, 3.0],
        # a third of the rows is one value, spread over several slices of ranks
        "other ": [7.0] * 6000 + [rng.uniform(0, 30) for _ in range(12000)], "normal ": [rng.gauss(0, 1) for _ in range(11)],
    }


@pytest.mark.parametrize("shape", list(_shapes()))
def test_shapes_of_distributions(spark, shape):
    values = _shapes()[shape]
    df = spark.createDataFrame([(v, "x") for v in values] + [(None, "x"), (float("nan"), "x")], "v double, n string").repartition(3)
    assert profile.distribution_type(df, "v").collect()[0].kind == shape.strip()
    got = profile.order_statistics(df, "v").collect()[0]
    assert (got.n, got.n_distinct) == (len(values), len(set(values)))
    if len(values) < 8:
        assert got.w is None and got.p_uniform is None
        return
    w, p = plain_shapiro(values)
    assert math.isclose(got.w, w, rel_tol=1e-7) and math.isclose(got.p_normal, p, rel_tol=1e-3, abs_tol=1e-6)
    d, pu = plain_uniform(values)
    assert math.isclose(got.d, d, rel_tol=1e-9) and math.isclose(got.p_uniform, pu, rel_tol=1e-6, abs_tol=1e-9)
    if min(values) > 0:
        assert math.isclose(got.w_log, plain_shapiro([math.log(v) for v in values])[0], rel_tol=1e-7)
    else:
        assert got.w_log is None


def test_shapes_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    for rows in (df, df.filter("false")):
        assert profile.distribution_type(rows, "v").collect()[0].kind == "too_few_values"
    same = spark.createDataFrame([(2.0,)] * 20, "v double")
    got = profile.order_statistics(same, "v").collect()[0]
    assert got.w is None and profile.distribution_type(same, "v").collect()[0].kind == "categorical"


def test_reports_on_personal_data(spark):
    rows = [("ann@example.org wrote", 1, None), ("bob@example.org, ann@example.org", 2, ""), ("bob@example.org", 3, " "), ("call 415-555-0100", 4, "clean"), (None, 5, "192.168.10.1"), ("nothing", 6, None)]
    df = spark.createDataFrame(rows, "a string, column int, c string").repartition(3)
    found = {(r["column"], r.pii_type): r for r in guards.pii_findings(df, ["a", "column", "c"]).collect()}
    mail = found["a", "email"]
    assert (mail.severity, mail.match_count, mail.fraction, mail.masked_examples) == ("high", 3, 0.6, ["an***@example.org", "bo***@example.org", "bo***@example.org"])
    assert found["a", "phone"].masked_examples == ["***-***-0100"] and found["c", "ip_address"].fraction == 0.5
    for (c, k), r in found.items():
        matches = [str(x) for x in (row[["a", "column", "c"].index(c)] for row in rows) if x is not None and str(x).strip() and re.search(guards.PII[k], str(x))]
        assert r.match_count == len(matches)
    report = guards.pii_compliance(df, guards.pii_findings(df, ["a", "column", "c"])).collect()[0]
    assert report.asDict() == {"rows_scanned": 6, "affected_columns": ["a", "c"], "critical_columns": ["a"], "compliant": False}
    empty = df.filter("false")
    assert guards.pii_compliance(empty, guards.pii_findings(empty, ["a"])).collect()[0].compliant
