"""What only shows on larger tables, or on tables shaped like them: counts beyond 64 bits, quantiles of many values, pairs, graphs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import blocks, centrality, drift, experiment, graph, monitoring, recommending, recsys, resolve, text


def test_log_rank_of_many_rows(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") % 4).alias("t"), (F.col("id") % 3 > 0).cast("int").alias("e"), (F.col("id") % 2 == 0).alias("g"))
    seen = [(i % 4, int(i % 3 > 0), i % 2 == 0) for i in range(n)]
    o = e = v = 0.0
    for t in range(4):
        risk = [x for x in seen if x[0] >= t]
        r, ra, d = len(risk), sum(x[2] for x in risk), sum(x[1] for x in risk if x[0] == t)
        o += sum(x[1] for x in risk if x[0] == t and x[2])
        e += d * ra / r
        v += d * ra * (r - ra) * (r - d) / (r * r * (r - 1))
    got = experiment.log_rank(rows, "t", "e", "g", True).first()
    assert got.observed == o and abs(got.expected - e) < 1e-6 and abs(got.chi2 - (o - e) ** 2 / v) < 1e-9 * (o - e) ** 2 / v


def test_quantiles_of_many_values(spark):
    rng = np.random.default_rng(5)
    sides = {"a": (rng.normal(size=3000).round(3), rng.normal(0.1, 2, 1700)), "b": (np.zeros(4), np.array([7.0])), "c": (np.array([1.0, 2.0]), np.array([])), "d": (rng.integers(0, 9, 5000) / 7, rng.integers(0, 9, 40) / 7)}
    rows = [(k, s, float(x)) for k, two in sides.items() for s, values in zip(("ref", "cur"), two) for x in values] + [("a", "ref", None)]
    long = spark.createDataFrame(rows, "k string, side string, value double")
    got = {r.k: r.wasserstein for r in drift.wasserstein(long, ["k"]).collect()}
    at = [i / 999 for i in range(1000)]
    for k, (x, y) in sides.items():
        assert got[k] is None if not len(y) else abs(got[k] - np.abs(np.quantile(x, at) - np.quantile(y, at)).mean()) < 1e-12
    # no task takes a group's values together
    big = spark.range(300_000).select(F.when(F.col("id") % 2 == 0, "ref").otherwise("cur").alias("side"), F.lit("x").alias("column"), (F.col("id") * 1.0).alias("value"))
    assert "percentile" not in drift.wasserstein(big, ["column"])._jdf.queryExecution().toString()
    report = monitoring.extended_drift(big).first()
    assert report.wasserstein == 1.0 and report.js == 0.0 and report.severity == "ok"


def test_pairs_of_a_large_block(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 7)
    names = ["Ann Lee", "ann  lee", None, "Bo", "Supplier#0001", "Supplier#0017", "", "Ann Leeds"]
    rows = [(i, names[i * 5 % 8], None if i % 9 == 4 else i * 37 % 11 * 1.0, ("x" if i % 3 else " X") if i % 7 else None, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, bal double, tag string, g long")
    fields = {"name": ("text", 2.0), "bal": ("numeric", 1.0), "tag": ("exact", 0.5)}
    found = resolve.resolve(df, "id", ["g"], fields, 0.55)
    # each row meets the parts of its block, and parts are dealt to tasks
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() > 8
    a, b = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns]), df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns])
    pairs = a.join(b, F.col("a_g") == F.col("b_g")).filter("a_id < b_id")
    sims = {c: resolve.similarity(F.col(f"a_{c}"), F.col(f"b_{c}"), kind) for c, (kind, _) in fields.items()}
    total = sum((F.coalesce(s * fields[c][1], F.lit(0.0)) for c, s in sims.items()), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), fields[c][1]).otherwise(0.0) for c, s in sims.items()), F.lit(0.0))
    want = pairs.withColumn("score", F.round(F.try_divide(total, weight), 6)).filter("score >= 0.55").select("a_id", "b_id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50


def close(got, want):
    """Rows with a float or null in the place before the last."""
    got, want = sorted(got, key=lambda r: (r[0], r[-1])), sorted(want, key=lambda r: (r[0], r[-1]))
    return len(got) == len(want) and all((a[:-2], a[-1]) == (b[:-2], b[-1]) and (a[-2] is b[-2] or abs(a[-2] - b[-2]) < 1e-8) for a, b in zip(got, want))


@pytest.mark.parametrize("size", [64_000_000, 4000])  # one slice, and several
def test_comparables_of_points(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SLICE_BYTES", size)
    rng = np.random.default_rng(2)
    rows = [(f"n{i:04d}", float(rng.integers(0, 9)) if i % 17 else None, float(rng.integers(0, 40)) if i % 3 else float(rng.normal() * 20), float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a double, b double, p double")
    got = recsys.comparables(df, df.filter("p % 2 = 0"), "k", {"a": 1.0, "b": 2.0}, "p").select("k", "subject", "p", "distance", "rank").collect()
    x = np.array([[np.nan if r[1] is None else r[1], r[2]] for r in rows])
    x, want = (x - np.nanmin(x, 0)) / (np.nanmax(x, 0) - np.nanmin(x, 0)) * [1, 2], []
    for i in range(0, 900, 2):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        first = sorted((np.inf if np.isnan(far[j]) else round(far[j], 9), j) for j in range(900) if j != i)[:5]
        want += [(rows[i][0], rows[j][0], float(j), None if d == np.inf else d, n + 1) for n, (d, j) in enumerate(first)]
    assert close([(r.subject, r.k, r.p, r.distance, r["rank"]) for r in got], want)


@pytest.mark.parametrize("size", [64_000_000, 4000])
def test_factors_of_many_users(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SLICE_BYTES", size)
    rng = np.random.default_rng(4)
    factors = {i: rng.normal(size=5) for i in range(300)}
    ratings = [(u, int(i), float(rng.integers(1, 6))) for u in range(60) for i in rng.choice(310, 12, replace=False)] + [(99, 305, 1.0)]
    found = recommending.factor_recommend(spark.createDataFrame(ratings, "u long, i long, w double"), spark.createDataFrame([(i, v.tolist()) for i, v in factors.items()], "i long, e array<double>"), "u", "i", "w", "e", 5, 3)
    want = []
    for u in range(60):
        own = {i: w for a, i, w in ratings if a == u}
        v = sum(w * factors[i] for i, w in own.items() if i in factors)
        first = sorted((-round(float(v @ factors[i]), 3), i) for i in factors if i not in own)[:5]
        want += [(u, i, -s, n + 1) for n, (s, i) in enumerate(first)]
    assert close([tuple(r) for r in found.collect()], want)


@pytest.mark.parametrize("size", [64_000_000, 4000])
def test_nearest_of_all_rows(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SLICE_BYTES", size)
    v = np.random.default_rng(1).integers(-3, 4, (400, 4)).astype(float)
    found = recsys.nearest(spark.createDataFrame([(f"n{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, v array<double>"), "id", "v", 10)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    cos, want = np.round(u @ u.T, 6), []
    for i in range(400):
        want += [(f"n{i:03d}", f"n{j:03d}", -c, n + 1) for n, (c, j) in enumerate(sorted((-cos[i, j], j) for j in range(400) if j != i)[:10])]
    assert close([(r.q, r.id, r.cos, r["rank"]) for r in found.collect()], want)


def random_graph(n=150, m=900, seed=6):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in zip((n * rng.random(m) ** 3).astype(int), rng.integers(0, n, m)) if a != b}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return pairs, near


def plans_of(spark, monkeypatch, module, run):
    """The plans of what a module writes while ``run`` goes, and of its result, and the result."""
    plans, write = [], module.stage_table
    monkeypatch.setattr(module, "stage_table", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or write(df, *a))
    out = run()
    return plans + [out._jdf.queryExecution().toString()], out


def test_core_numbers_without_joins_in_rounds(spark, monkeypatch):
    pairs, near = random_graph()
    left, k, core = {a: set(b) for a, b in near.items()}, 0, {}
    while left:
        a = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[a]))
        core[f"n{a}"] = k
        for b in left.pop(a):
            left[b].discard(a)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    plans, out = plans_of(spark, monkeypatch, graph, lambda: graph.k_core(edges))
    assert {r.id: r.core for r in out.collect()} == core and len(set(core.values())) > 4
    assert len(plans) <= 5  # links, numbers and lists are written, not the rounds
    monkeypatch.setattr(graph, "SENT_NODES", 10)
    assert {r.id: r.core for r in graph.k_core(edges).collect()} == core


def test_triangles_without_wedges(spark, monkeypatch):
    pairs, near = random_graph()
    nodes = spark.createDataFrame([(i,) for i in range(150)], "id long")
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    got = {r.id: (r.k, r.triangles) for r in graph.clustering(nodes, edges).collect()}
    for i in range(150):
        own = near.get(i, set())
        assert got[i] == (len(own), sum(len(near[b] & own) for b in own) // 2)
    assert sum(t for _, t in got.values()) > 300
    # two-sided: no edge's upper end leads on, so nothing is sent
    stars = spark.createDataFrame([(a, 1000 + b) for a in range(40) for b in range(5)], "src long, dst long")
    sent, write = [], graph.stage_table
    monkeypatch.setattr(graph, "stage_table", lambda df, name, *a: sent.append((name, df.count())) or write(df, name, *a))
    assert graph.clustering(nodes.limit(40), stars).agg(F.sum("triangles")).first()[0] == 0 and dict(sent)["inner"] == 0


def test_topic_chunks_stay_in_their_rows(spark):
    same = "The red cat sat here. The red cat sat there. The red cat ran."
    rows = [(1, same + " Nothing alike follows now! Über-große Wörter, Über-große Wörter. " + "x y. " * 300), (2, None), (3, ""), (4, "... !"), (5, "one")]
    found = text.topic_chunks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", most=100)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    assert got[:2] == [(1, 0, same), (1, 1, "Nothing alike follows now!")] and got[-3:] == [(4, 0, "..."), (4, 1, "!"), (5, 0, "one")]
    assert " ".join(c for k, _, c in got if k == 1) == rows[0][1].strip() and [i for k, i, _ in got if k == 1] == list(range(len(got) - 3))
    assert all(len(c) <= 104 for k, _, c in got)


@pytest.mark.parametrize("size", [32_000_000, 3000])  # all sources at once, and a few
def test_betweenness_without_joins_in_rounds(spark, monkeypatch, size):
    monkeypatch.setattr(centrality, "SENT_BYTES", size)
    pairs, near = random_graph(120, 260)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    plans, out = plans_of(spark, monkeypatch, centrality, lambda: centrality.betweenness(edges))
    got = {r.id: r.betweenness for r in out.collect()}
    assert len(plans) <= 2  # links are written, not the levels
    both = spark.createDataFrame([(f"n{a}", f"n{b}") for a in near for b in near[a]], "src string, dst string")
    chosen = sorted((hashlib.md5(f"n{a}".encode()).hexdigest(), f"n{a}") for a in near)[:10]
    want = centrality._by_joins(both, spark.createDataFrame([(x,) for _, x in chosen], "id string"), len(near), 10)
    want = {r.id: r.betweenness for r in want.collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in got) < 1e-12 and max(got.values()) > 0.005
