"""The feature store: point-in-time joins against a plain search, upserts that may be replayed, definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import feature_store as S

DAY0 = dt.datetime(2024, 3, 1)


def _at(hours):
    return None if hours is None else DAY0 + dt.timedelta(hours=hours)


@pytest.mark.parametrize(("ttl", "width"), [(None, "7 days"), ("30 HOURS", "7 days"), ("2 DAYS", "6 hours")])
def test_as_of_join(spark, ttl, width):
    rng = random.Random(1)
    keys = ["hot"] * 5 + ["a", "b", None]
    history = [(rng.choice(keys), _at(rng.choice([None, *range(200)])), _at(rng.randrange(3)), rng.choice([None, rng.randrange(9)]), rng.random()) for _ in range(400)]
    rows = [(i, rng.choice([*keys, "new"]), _at(rng.choice([None, *range(-10, 260)])), "clash", 5.0) for i in range(300)]
    rows += rows[:20]
    h = spark.createDataFrame(history, "k string, known timestamp, created timestamp, f int, g double")
    r = spark.createDataFrame(rows, "i int, k string, at timestamp, v string, g double")
    got = S.as_of_join(r, h, "k", "at", "known", ["f", "g"], created="created", ttl=ttl, width=width, age="age")
    assert got.columns == ["i", "k", "at", "v", "f", "g", "age"]
    limit = {None: dt.timedelta(days=999), "30 HOURS": dt.timedelta(hours=30), "2 DAYS": dt.timedelta(days=2)}[ttl]
    want = []
    for i, k, at, v, _ in rows:
        past = [x for x in history if x[0] == k is not None and x[1] is not None and at is not None and x[1] <= at]
        low = -1  # nulls come first
        best = max(past, key=lambda x: (x[1], x[2], low if x[3] is None else x[3], x[4]), default=None)
        ok = best is not None and best[1] + limit >= at
        want.append((i, k, at, v, best[3] if ok else None, best[4] if ok else None, (at - best[1]).total_seconds() if ok else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert S.as_of_join(r, h.filter("false"), "k", "at", "known", ["f"]).filter("f IS NOT NULL").count() == 0
    assert S.as_of_join(r.filter("false"), h, "k", "at", "known", ["f"]).count() == 0


def test_registry(spark, tmp_path):
    reg = S.FeatureRegistry(spark, str(tmp_path / "reg"))
    assert reg.features() == []
    reg.register("n_orders", "int", "user", "orders so far")
    reg.register("price", "float", "item")
    assert [x["name"] for x in reg.features()] == ["n_orders", "price"] and [x["name"] for x in reg.features("item")] == ["price"]
    with pytest.raises(ValueError, match="registered"):
        reg.register("price", "int")
    with pytest.raises(ValueError, match="none of"):
        reg.register("other", "decimal")
    with pytest.raises(ValueError, match="not a name"):
        reg.register("a/b", "int")
    df = spark.createDataFrame([(1, 2.0)], "n_orders long, price double")
    assert reg.checked(df, ["n_orders", "price"]) is df
    with pytest.raises(KeyError):
        reg.checked(df, ["n_orders", "size"])
    with pytest.raises(TypeError):
        reg.checked(df.withColumn("price", F.lit("x")), ["price"])


FIELDS = "k long, ts timestamp, a int, b string"


def _store(spark, path):
    return S.OnlineStore(spark, str(path), "k", "ts", {"a": "int", "b": "string"}, buckets=4)


def _plain(batches):
    """Per key the greatest time, and per feature the value of the greatest time at which it is not null."""
    rows = [r for b in batches for r in b if r[0] is not None and r[1] is not None]
    out = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        last = lambda i, mine=mine: max(((r[1], r[i]) for r in mine if r[i] is not None), default=(None, None))[1]
        out[k] = (max(r[1] for r in mine), last(2), last(3))
    return out


def test_online_store(spark, tmp_path):
    rng = random.Random(2)
    store = _store(spark, tmp_path / "s")
    assert store.read().count() == 0 and store.versions() == []
    batches = [[(rng.choice([None, *range(30)]), _at(rng.choice([None, *range(100)])), rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"])) for _ in range(80)] for _ in range(4)]
    dfs = [spark.createDataFrame(b, FIELDS) for b in batches]
    assert store.upsert(dfs[0], 0) == 1
    first = store.read().collect()
    for i in (2, 1, 3):  # out of order
        store.upsert(dfs[i], i)
    assert store.upsert(dfs[1], 1) == 4 and store.upsert(dfs[2]) == 5  # a known batch makes no version; unnamed rows once more change nothing
    got = {r.k: (r.ts, r.a, r.b) for r in store.read().collect()}
    assert got == _plain(batches)
    assert sorted(map(repr, store.read(1).collect())) == sorted(map(repr, first)) and store.versions() == [1, 2, 3, 4, 5]
    assert store.upsert(dfs[0].filter("k IS NULL"), "none") == 5
    # some of the features; only buckets of the keys are written anew
    before = store.manifest()["files"]
    store.upsert(spark.createDataFrame([(3, _at(500), 77)], "k long, ts timestamp, a int"), "part")
    after = store.manifest()["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    k3 = store.read().filter("k = 3").first()
    assert (k3.a, k3.b) == (77, _plain(batches)[3][2])
    asked = spark.createDataFrame([(3, "p", 1), (999, "q", 2), (None, "r", 3)], "k long, who string, a int")
    found = {r.who: r for r in store.lookup(asked).collect()}
    assert found["p"].a == 77 and sorted(found["q"].missing) == ["a", "b"] and found["r"].a is None
    old = {r.who: r for r in store.lookup(asked, ["a"], ttl="1 HOUR", as_of=F.lit(_at(502))).collect()}
    assert old["p"].a is None and old["p"].missing == ["a"]
    with pytest.raises(ValueError, match="buckets"):
        S.OnlineStore(spark, str(tmp_path / "s"), "k", "ts", {"a": "int"}, buckets=5).read()


def test_online_store_follows_a_stream(spark, tmp_path):
    """Stopped and started again, with the checkpoint lost in between: every row arrives twice, the store is the same."""
    rng = random.Random(3)
    batches = [[(rng.randrange(9), _at(rng.randrange(50)), rng.randrange(9), rng.choice([None, "x"])) for _ in range(30)] for _ in range(3)]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, FIELDS).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    store = _store(spark, tmp_path / "s")
    for checkpoint in ("cp", "cp", "other"):
        stream = spark.readStream.schema(FIELDS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = store.follow(stream, str(tmp_path / checkpoint))
        q.processAllAvailable()
        q.stop()
        assert {r.k: (r.ts, r.a, r.b) for r in store.read().collect()} == _plain(batches)
    assert store.versions()[-1] == 6
