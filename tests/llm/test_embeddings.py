"""Near vectors against brute force, clusters against plain integers."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import balls, neighbours

SINGLE = "vec_id long, embedding array<float>, n_links string, node string, component_id long, row string"


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def at_cosine(rng, base, c):
    """A unit vector at exactly this cosine to a unit vector."""
    other = rng.standard_normal(len(base))
    other = unit(other - (other @ base) * base)
    return c * base + math.sqrt(1 - c * c) * other


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies, exact copies, pairs on both sides of the threshold, a chain, and vectors without direction."""
    rng = np.random.default_rng(5)
    out = list(unit(rng.standard_normal((300, 64))))
    base = unit(rng.standard_normal(64))
    out += [unit(base + 0.03 * rng.standard_normal(64)) for _ in range(700)]  # one large group
    for c in (0.86, 0.89, 0.93, 0.96, 0.99):
        for b in unit(rng.standard_normal((8, 64))):
            out += [b, at_cosine(rng, b, c)]
    chain = [unit(rng.standard_normal(64))]
    for _ in range(6):
        chain.append(at_cosine(rng, chain[-1], 0.97))
    out += chain + [base] * 400
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [float("nan")] * 64), (n + 4, [float("inf")] + [1.0] * 63), (n + 5, [None] + [1.0] * 63)]
    rows += [(n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e30] * 64), (n + 9, [1e-30] * 64), (n + 10, [-0.0, 1.0]), (n + 11, [0.0, 1.0])]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1])]
    return [(*r, "clash", "clash", 5, "clash") for r in rows]


def brute(rows, cosine=0.9):
    """Links of each row and least ids by components; also the pairs."""
    good = [i for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    pairs, parent = set(), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for size in {len(rows[i][1]) for i in good}:
        mine = [i for i in good if len(rows[i][1]) == size]
        x = unit(np.array([rows[i][1] for i in mine], np.float64))
        for a, b in np.argwhere(np.triu(x @ x.T >= cosine, 1)):
            pairs.add((mine[a], mine[b]))
            parent[top(mine[a])] = top(mine[b])
    links, least = [0] * len(rows), {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return [(r[0], links[i], least.get(top(i)), r[0] == least.get(top(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [100, 100_000])
def test_near_vectors(spark, planted, monkeypatch, block):
    """With a bucket of one block, and of many; equal vectors sent and joined."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    df = spark.createDataFrame(planted, SINGLE).repartition(7)
    got = neighbours.near_vectors(df, recall=1 - 1e-9)
    assert got.columns == ["vec_id", "embedding", "node", "row", "n_links", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()))) == sorted(map(repr, brute(planted)))


def test_doubles_and_other_ids(spark):
    rows = [("b", [3.0, 4.0, 0.0]), ("a", [6e200, 8e200, 0.0]), ("c", [4e-200, -3e-200, 0.0]), ("d", [10.0, 0.0, 0.0, 0.0]), ("e", [9.0, 3.0, 3.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c"), "d": (1, "d"), "e": (1, "d")}  # the last two have a cosine of 0.9 exactly
    none = spark.createDataFrame([], SINGLE)
    assert neighbours.near_vectors(none).count() == 0 and neighbours.op11_neighbours(none).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert neighbours.near_vectors(spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")).count() == 2


def test_recall_at_the_threshold():
    """Pairs right above the threshold, in tables as made for two million vectors: found as often as promised."""
    rng = np.random.default_rng(3)
    k, tables = neighbours.plan(2_000_000, 0.9, 0.99)
    one = unit(rng.standard_normal((4000, 64)))
    two = np.array([at_cosine(rng, b, 0.9001) for b in one])
    x, y = neighbours.codes(one, k, tables, 11), neighbours.codes(two, k, tables, 11)
    assert (x == y).any(axis=1).mean() > 0.98
    far = neighbours.codes(unit(rng.standard_normal((4000, 64))), k, tables, 11)
    assert (x == far).mean() < 3 * 1024 / 2_000_000  # about as few unrelated meetings as meant
    assert abs((x[:, 0] == y[:, 0]).mean() - neighbours.collision(math.sqrt(0.2)) ** k) < 0.03
    # a code depends on nothing but its vector
    assert (neighbours.codes(one[17:18], k, tables, 11) == x[17]).all()


def test_recall_on_a_table(spark):
    """All links of a table with many pairs near the threshold against brute force."""
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for b in unit(rng.standard_normal((1500, 64))):
        rows += [(n, [float(x) for x in b]), (n + 1, [float(x) for x in at_cosine(rng, b, rng.uniform(0.9, 0.93))])]
        n += 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbours.near_vectors(df).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.985 * sum(want.values())


# -- clusters ------------------------------------------------------------------------------------------------------
def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q))
    for t in range(rounds + 1):
        number = [min(range(len(at)), key=lambda c, v=v: (far(v, at[c]), c)) for _, v in kept]
        if t < rounds:
            for c in range(len(at)):
                mine = [v for (_, v), m in zip(kept, number) if m == c]
                if mine:
                    at[c] = [sum(col) // len(mine) for col in zip(*mine)]
    d = [far(v, at[c]) for (_, v), c in zip(kept, number)]
    own = [sum(x for x, m in zip(d, number) if m == c) for c in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, c, x, own[c], sum(d), digest[c]) for (i, _), c, x in zip(kept, number, d)]


def test_clusters(spark, planted, monkeypatch):
    rows = [r[:2] for r in planted if r[0] != max(x[0] or 0 for x in planted) and (r[1] is None or not any(x and abs(x) > 1e20 for x in r[1] if x is not None))]
    want = sorted(map(repr, plain_clusters(rows)))
    for parts, size in ((1, 4096), (9, 100)):
        monkeypatch.setattr(balls, "TREE_ROWS", size)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(parts)
        assert sorted(map(repr, map(tuple, balls.op13_clusters(df).collect()))) == want


def test_clusters_of_wide_numbers(spark):
    """Components whose integers exceed doubles: exact too, a distance beyond a long is null."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-50, 50, 64) * (1e7 if i % 5 == 0 else 0.01)]) for i in range(60)] + [(99, [1e300] + [0.0] * 63)]
    got = {r.vec_id: r for r in balls.op13_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    kept = [(i, [(a * 64) // b for a, b in (x.as_integer_ratio() for x in v)]) for i, v in rows]
    want = {r[0]: r for r in plain_clusters([(i, v) for i, v in kept], scale=1)}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.cluster == want[i][1] and r.centroid_sha256 == want[i][5]
        assert r.distance == (want[i][2] if want[i][2] < 1 << 63 else None)


def test_few_and_none(spark):
    df = spark.createDataFrame([(2, [1.0] * 64), (2, [1.0] * 64), (None, [0.5] * 64), (3, [1.0] * 63)], "vec_id long, embedding array<float>")
    assert sorted(map(repr, map(tuple, balls.op13_clusters(df).collect()))) == sorted(map(repr, plain_clusters([(r.vec_id, r.embedding) for r in df.collect()])))
    assert balls.op13_clusters(df.filter("false")).count() == 0
    assert balls.op13_clusters(df.filter("vec_id = 3")).count() == 0


def test_whole_balls_are_assigned():
    """Tight groups are taken as balls; the result is that of comparing all points."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (16, 64)).astype(float)
    points = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 2, (4000, 64)))
    tree = balls.Tree(points.copy(), wide=False)
    assert (tree.points == points[tree.order]).all()
    number, counts, sums, tried = tree.assign(centres)
    d = ((tree.points[:, None] - centres) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and tried < len(points)
    assert (counts == np.bincount(number, minlength=16)).all() and all((sums[c] == tree.points[number == c].sum(axis=0)).all() for c in range(16))
    back = balls._loaded({**balls._stored(tree, list(range(4000)), 64)})
    assert (back.assign(centres)[0] == number).all() and (back.radii == tree.radii).all()
    # ties go to the smaller number
    same = np.repeat(centres[:1], 3, axis=0)
    assert (tree.assign(same)[0] == 0).all()


@pytest.mark.parametrize("name", ["op11_neighbours", "op12_infill", "op13_clusters"])
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from loomery.llm import queries

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    for t in ("documents", "embeddings"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    theirs = duckdb.sql(queries.oracle_sql()[name]).select(*df.columns).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, theirs))
