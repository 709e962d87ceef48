"""Queries take all rows: against their SQL, or plain versions, on small driver tables."""

import math
import os
from collections import Counter, defaultdict

import pytest

from loomery.plans import catalogue, texts

duckdb = pytest.importorskip("duckdb")
ROOT = os.environ.get("TEST_DIR", "/root/testdata")
WHOLE_GRAPH = texts._N
SQL_QUERIES = "bm25_search rrf_fusion lexical_rerank ir_metrics cooccurrence_graph entity_linking degree_centrality connected_components temporal_graph_features clustering_coefficient pagerank_20 content_cosine content_recommend comps_knn".split()


def duck(folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in os.listdir(folder):
        if t.endswith(".parquet"):
            c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}'")
    return c


def plain(v):
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else float(f"{float(v):.7g}")
    return v


def same(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.5e-5 + 1e-6 * abs(y)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_all_rows_count(spark, name):
    folder = f"{ROOT}/sf0.01" if name == "entity_linking" else f"{ROOT}/sf0.001"  # more than 200 parts
    c = duck(folder)
    found = c.execute(catalogue.oracle_sql()[name])
    names = sorted(x[0] for x in found.description)
    theirs = sorted((tuple(plain(dict(zip([x[0] for x in found.description], r))[n]) for n in names) for r in found.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in catalogue.queries()[name](spark, folder).collect()), key=repr)
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.fixture(scope="module")
def neighbours():
    out = defaultdict(set)
    for a, b in duck(f"{ROOT}/sf0.001").execute(f"WITH {WHOLE_GRAPH} SELECT src, dst FROM e").fetchall():
        out[a].add(b)
        out[b].add(a)
    return out


def test_kcore_of_the_whole_graph(spark, neighbours):
    left, k, core = {a: set(b) for a, b in neighbours.items()}, 0, {}
    while left:
        a = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[a]))
        core[a] = k
        for b in left.pop(a):
            left[b].discard(a)
    assert {r.id: r.core for r in catalogue.queries()["kcore"](spark, f"{ROOT}/sf0.001").collect()} == core


def test_labels_of_the_whole_graph(spark, neighbours):
    labels = {a: a for a in neighbours}
    for _ in range(5):
        votes = {a: Counter(labels[b] for b in near) for a, near in neighbours.items()}
        labels = {a: min(v, key=lambda x: (-v[x], x)) for a, v in votes.items()}
    assert {r.id: r.label for r in catalogue.queries()["label_propagation"](spark, f"{ROOT}/sf0.001").collect()} == labels


def test_blocks_see_each_pair_once(spark, monkeypatch):
    import pandas as pd

    from loomery.operators.blocks import over_block_pairs

    a, b = spark.range(23).withColumnRenamed("id", "x"), spark.range(17).withColumnRenamed("id", "y")
    got = over_block_pairs(a, b, "x", "y", lambda p, q: pd.merge(p, q, how="cross"), "x long, y long", rows=5).collect()
    assert sorted((r.x, r.y) for r in got) == [(x, y) for x in range(23) for y in range(17)]


def test_long_mentions_and_late_parts(spark, tmp_path):
    spark.createDataFrame([(1, "ACME  with  GLOBALCORP"), (2, "GLOBALCORP and ACME")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = [(i, f"{i:04d} plain {i * 7919 % 9973:04d} part") for i in range(1, 301)]
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in catalogue.queries()["cooccurrence_graph"](spark, str(tmp_path)).collect()] == [("ACME", "GLOBALCORP", 2)]
    grams = {i: {n[j : j + 3] for j in range(len(n) - 2)} for i, n in names}
    want = set()
    for i, n in names:
        near = [(-round(len(grams[i] & grams[j]) / len(grams[i] | grams[j]), 6), j) for j, _ in names if len(grams[i] & grams[j]) >= 0.6 * len(grams[i] | grams[j])]
        want |= {(n, j, -s, k + 1) for k, (s, j) in enumerate(sorted(near)[:5])}
    got = catalogue.queries()["entity_linking"](spark, str(tmp_path)).collect()
    assert {(r.mention, r.entity, r.score, r["rank"]) for r in got} == want and len({r.mention for r in got}) == 300


def test_mmd_sums_over_all_rows(spark):
    import numpy as np

    from loomery.operators import drift

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2300, 3)), np.vstack([rng.normal(size=(2100, 3)), rng.normal(4, 1, (300, 3))])
    side = lambda v: spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id long, v array<double>")
    mean = lambda p, q: np.exp(-0.2 * ((p[:, None, :] - q[None, :, :]) ** 2).sum(2)).mean()
    want = mean(x, x) + mean(y, y) - 2 * mean(x, y)
    assert drift.mmd_rbf(side(x), side(y), "v", 0.2).first().mmd == pytest.approx(want, abs=1e-9)
