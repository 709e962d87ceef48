"""Operators without SQL form: known values, plain versions, stream against batch."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.functions import stats
from loomery.operators import graph, image, models, profile, resolve, text, timeseries
from loomery.operators import components
from loomery.operators.components import connected_components
from loomery.operators.ranking import running_offsets
from loomery.streaming import detectors


def test_tail_probabilities(spark):
    assert stats.gamma_q(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.gamma_q(5, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    row = spark.range(1).select(stats.chi2_sf_1(F.lit(3.841459)).alias("a"), stats.normal_two_sided(F.lit(-1.959964)).alias("b")).first()
    assert row.a == pytest.approx(0.05, abs=1e-5) and row.b == pytest.approx(0.05, abs=1e-5)


def test_running_offsets(spark):
    rows = [("a", i % 3, i, i % 5) for i in range(50)] + [("b", 0, 7, 2)]
    df = spark.createDataFrame(rows, "g string, cell int, x int, w int")
    got = running_offsets(df, ["g"], "cell", [F.col("x")], F.col("w")).collect()
    for r in got:
        before = [w for g, c, x, w in rows if g == r.g and (c, x) < (r.cell, r.x)]
        assert r.start == sum(before) and r.total == sum(w for g, *_, w in rows if g == r.g)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 8), (8, 9), (9, 10), (20, 20), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{k: 4 for k in range(4, 11)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_many_tasks(spark, monkeypatch):
    """Chains and random edges whose parts are in several tasks, and ids that are text."""
    monkeypatch.setattr(components, "tasks_for", lambda n: max(1, -(-n // 60)))
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(150)] + [(draw.randrange(1000, 1300), draw.randrange(1000, 1300)) for _ in range(150)] + [(2000, 2000 + i) for i in range(1, 90)]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    rows = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    assert {r.id: r.component for r in connected_components(rows).collect()} == want
    named = rows.select(*[F.format_string("é%05d", c).alias(c) for c in ("src", "dst")])
    assert {r.id: r.component for r in connected_components(named).collect()} == {f"é{a:05d}": f"é{b:05d}" for a, b in want.items()}


def test_contraction_in_pieces(monkeypatch):
    """What a task contracts together is bounded: pieces give stars of their own, with the same components."""
    monkeypatch.setattr(components, "TOGETHER", 25)
    draw = random.Random(6)
    pairs = sorted({(max(e), min(e)) for e in ((draw.randrange(80), draw.randrange(80)) for _ in range(60)) if e[0] != e[1]})
    table = pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})
    made = list(components._contract(iter(table.to_batches(10))))
    stars = [(u, v) for x in made for u, v in zip(x.column("u").to_pylist(), x.column("v").to_pylist())]
    assert len(made) == -(-len(pairs) // 30) and all(u > v for u, v in stars)
    whole = lambda edges: dict(zip(*(x.tolist() for x in components.contracted(*np.array(edges).T))))
    want = {x: x for e in pairs for x in e}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert whole(pairs) == whole(stars) == {a: b for a, b in want.items() if a != b}


def test_components_of_one_task_take_few_jobs(spark):
    """Each job leaves its plans and broadcasts in the driver's memory: a chain's length must not add to them."""
    rows = spark.createDataFrame([(i, i + 1) for i in range(2000)], "src long, dst long")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = connected_components(rows)
        n_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.filter("component = 0").count() == 2001 and n_jobs <= 12


def test_core_numbers(spark):
    k5 = [(a, b) for a in range(5) for b in range(a)] + [(0, 9)]
    got = {r.id: r.core for r in graph.k_core(spark.createDataFrame(k5, "src long, dst long")).collect()}
    assert got == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 9: 1}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert graph.pagerank(n, e, 10).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_suite_and_contract(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "x int, y string")
    C = profile.Check
    got = [(r.id, r.passed, r.violations) for r in profile.run_suite(df, [C("not_null", "x"), C("unique", "x"), C("in_set", "y", allowed=["a"]), C("odd", "x"), C("exists", "z")]).orderBy("id").collect()]
    assert got == [(0, False, 1), (1, False, 1), (2, False, 1), (3, False, None), (4, False, None)]
    assert {(r.column, r.dtype, r.nullable) for r in profile.infer_contract(df).collect()} == {("x", "integer", True), ("y", "string", True)}


def test_similarities(spark):
    r = spark.range(1).select(
        resolve.similarity(F.lit("abcd"), F.lit("abcd"), "text").alias("a"), resolve.similarity(F.lit(" A"), F.lit("a "), "exact").alias("b"), resolve.similarity(F.lit("100"), F.lit("105"), "numeric").alias("c"),
        resolve.similarity(F.lit("x"), F.lit("1"), "numeric").alias("d"), resolve.blocking_key([F.lit("Smith"), F.lit(None).cast("string")]).alias("k"),
    ).first()
    assert tuple(r) == (1.0, 1.0, 1.0, 0.0, "smi|__missing__")


def test_bio(spark):
    rows = [(1, 0, "Ann", "B-PER"), (1, 1, "Lee", "I-PER"), (1, 2, "saw", "O"), (1, 3, "x", "I-LOC"), (1, 4, "Rome", "B-LOC")]
    got = text.decode_bio(spark.createDataFrame(rows, "s int, i int, w string, t string"), "s", "i", "w", "t").collect()
    assert {(r.text, r.kind) for r in got} == {("Ann Lee", "PER"), ("Rome", "LOC")}


def test_uncertainty(spark):
    p = F.array(F.lit(0.2), F.lit(0.5))
    r = spark.range(1).select(text.uncertainty(p, "least_confidence"), text.uncertainty(p, "margin"), text.uncertainty(p, "entropy")).first()
    assert r[0] == 0.5 and r[1] == pytest.approx(0.3) and r[2] == pytest.approx((1 + 0.7219281) / 2)


def test_hidden_states():
    rng = np.random.default_rng(0)
    y = np.r_[rng.normal(0, 1, 60), rng.normal(6, 1, 20), rng.normal(0, 1, 40)]
    path, high, _ = timeseries.gaussian_hmm(y)
    assert path[60:80].mean() > 0.9 and path[:60].mean() < 0.1 and high[70] > 0.9
    x = np.r_[rng.normal(0, 1, (200, 2)), [[9.0, 9.0]]]
    assert timeseries.isolation_scores(timeseries.isolation_trees(x), x).argmax() == 200
    assert len(timeseries.echo_state_errors(y)) == len(y)


def test_images(spark):
    g = [[255] * 40 for _ in range(40)]
    for i in range(10, 20):
        g[i][5:35] = [0] * 30
    r = image.measure(spark.createDataFrame([(1, g), (2, None)], "id int, px array<array<int>>"), "px").orderBy("id").collect()
    assert r[0].n_zones == 1 and r[0].otsu < 255 and r[1].quality == pytest.approx(0.15)
    ink = np.zeros((5, 5), int)
    ink[1:4, 1:4] = 1
    assert image.erode(ink).sum() == 1 and image.dilate(image.erode(ink)).sum() == 9


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 600)
    t = rng.exponential(1 / np.exp(0.8 * x))
    df = spark.createDataFrame([(float(a), float(b), 1) for a, b in zip(x, t)], "x double, t double, e int")
    beta = models.cox(df, ["x"], "t", "e").first().beta / x.std()
    assert beta == pytest.approx(0.8, abs=0.15)
    q = models.quantize(spark.createDataFrame([("a", 1.27), ("a", -0.64), ("b", 0.0)], "g string, w double"), "w", ["g"]).collect()
    assert {r.q for r in q} == {127, -64, 0}
    u = models.local_updates(spark.createDataFrame([(i % 2, float(i), i % 3 == 0) for i in range(20)], "c int, f double, y boolean").withColumn("y", F.col("y").cast("int")), "c", ["f"], "y")
    assert models.federated_average(u, "position", "weight", "n").count() == 2


def test_stream_is_batch(spark, tmp_path):
    rows = [(f"k{i % 2}", i, float(100 + 50 * math.sin(i) + (200 if 40 < i < 60 else 0))) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    for part in range(4):
        df.filter(F.col("o").between(part * 20, part * 20 + 19)).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detectors.cusum_stream(stream, "k", "o", "v", 100.0, 40.0).writeStream.format("memory").queryName("cs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = timeseries.cusum(df, ["k"], "o", "v", F.lit(100.0), F.lit(40.0))
    ours = sorted((r.k, int(r.o), round(r.hi, 9), round(r.lo, 9), r.alarm) for r in spark.sql("SELECT * FROM cs").collect())
    assert ours == sorted((r.k, int(r.o), round(r.hi, 9), round(r.lo, 9), r.alarm) for r in batch.collect())
