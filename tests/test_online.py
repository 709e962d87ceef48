"""Recurrences: against plain versions, in batch and on streams with rows out of order and delivered twice."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import quality_control, recurrences, timeseries
from loomery.streaming import stateful

START = dt.datetime(2024, 1, 1)


class PlainWindow:
    """ADWIN with the values themselves in its buckets."""

    def __init__(self, delta=0.002):
        self.buckets, self.n, self.delta = [], 0, delta

    def add(self, value):
        self.buckets.append([value])
        size = 1
        while sum(len(b) == size for b in self.buckets) > 5:
            i = next(i for i, b in enumerate(self.buckets) if len(b) == size)
            self.buckets[i : i + 2] = [self.buckets[i] + self.buckets[i + 1]]
            size *= 2
        self.n += 1
        whole = sum(self.buckets, [])
        if self.n % 32 or len(whole) <= 10:
            return False
        cut = False
        while len(self.buckets) > 1:
            whole, at, found = np.array(sum(self.buckets, [])), 0, False
            strict = math.log(2 * math.log(len(whole)) / self.delta)
            for b in self.buckets[:-1]:
                at += len(b)
                if min(at, len(whole) - at) >= 5:
                    m = 1 / at + 1 / (len(whole) - at)
                    found |= abs(whole[:at].mean() - whole[at:].mean()) > math.sqrt(2 * m * whole.var() * strict) + 2 / 3 * m * strict
            if not found:
                break
            self.buckets, cut = self.buckets[1:], True
        return cut


def test_adaptive_window():
    rng = random.Random(1)
    for change in (None, 700):
        ours, plain, cuts = recurrences.AdaptiveWindow(), PlainWindow(), []
        for i in range(1500):
            v = float(rng.random() < (0.2 if change is None or i < change else 0.6))
            cut = ours.add(v)
            assert cut == plain.add(v)
            if cut:
                cuts.append(i)
            whole = sum(plain.buckets, [])
            assert ours.width == len(whole) and ours.mean == pytest.approx(np.mean(whole))
        assert len(ours.sizes) <= 6 * math.ceil(math.log2(1500))
        assert cuts == [] if change is None else 700 < cuts[0] < 900 and abs(ours.mean - 0.6) < 0.1


def _learned(rows, n, chunks=1, **kw):
    learner = recurrences.OnlineLearner(n, **kw)
    state, out = learner.start(), []
    for part in np.array_split(np.arange(len(rows)), chunks):
        state, made = learner.step(state, [rows[i] for i in part])
        out += made
    return state, out


def test_learner_is_naive_bayes_until_it_grows():
    """The chance before each row, from all rows before it, by the formula."""
    rng = np.random.default_rng(2)
    rows = [(int(y), float(rng.normal(2 * y, 1)), float(rng.normal(0, 3)), None if rng.random() < 0.1 else 1.0 * y) for y in rng.integers(0, 2, 90)]
    _, made = _learned(rows, 3, grace=1000)
    x = np.array([[math.nan if v is None else v for v in r[1:]] for r in rows])
    for t in (5, 30, 89):
        # each row was learned with the scale as of then
        def scale(row, upto):
            past = x[: upto + 1]
            mean, sd = np.nanmean(past, axis=0), np.nanstd(past, axis=0)
            return np.where(np.isnan(row) | (sd < 1e-12), 0.0, (row - mean) / np.where(sd < 1e-12, 1, sd))

        seen = np.array([scale(x[i], i) for i in range(t)])
        y = np.array([r[0] for r in rows[:t]])
        now, logs = scale(x[t], t - 1), []
        for c in (0, 1):
            mine = seen[y == c]
            if not len(mine):
                logs.append(-np.inf)
                continue
            var = mine.var(axis=0)
            ok = (len(mine) > 1) & (var > 1e-12)
            logs.append(math.log(len(mine) / t) + sum(-0.5 * math.log(2 * math.pi * v) - (a - m) ** 2 / (2 * v) for a, m, v, k in zip(now, mine.mean(axis=0), var, ok) if k))
        want = 1 / (1 + math.exp(min(700, logs[0] - logs[1]))) if np.isfinite(logs).all() else float(np.isfinite(logs[1]))
        assert made[t][0] == pytest.approx(want, abs=1e-6)


def test_learner_grows_and_finds_drift():
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (4000, 2))
    y = ((np.abs(x[:, 0]) > 0.5) & (x[:, 1] > -0.6)).astype(int)  # no single Gaussian tells these apart
    y[2500:] = 1 - y[2500:]
    rows = [(int(b), *map(float, a)) for a, b in zip(x, y)]
    state, made = _learned(rows, 2)
    again, parts = _learned(rows, 2, chunks=37)
    assert made == parts and state == again  # the typed state carries everything
    drifts = [i for i, m in enumerate(made) if m[3]]
    assert drifts and not [i for i in drifts if 1200 < i < 2500] and [i for i in drifts if 2500 <= i < 2800]
    assert np.mean([m[2] for m in made[2000:2500]]) < 0.25
    assert made[-1][5] == 4000 and made[-1][6] == len(drifts)
    small, _ = _learned(rows, 2, max_leaves=2)
    assert len(small[6]) <= 3 and len(state[6]) > 3
    none = _learned([(None, 1.0, None), (1, None, None)], 2)[1]
    assert none[0][:3] == (0.5, 0, None) and none[1][5] == 1


def _filtered(values, pi, a, mu, sd):
    """Chance of each state after the last value, by summing over all paths."""
    k, total, best = len(pi), np.zeros(len(pi)), [-1.0] * len(pi)
    emit = lambda v, s: math.exp(-0.5 * ((v - mu[s]) / sd[s]) ** 2) / (sd[s] * math.sqrt(2 * math.pi))
    for code in range(k ** len(values)):
        path = [code // k**i % k for i in range(len(values))]
        p = pi[path[0]] * emit(values[0], path[0])
        for i in range(1, len(values)):
            p *= a[path[i - 1]][path[i]] * emit(values[i], path[i])
        total[path[-1]] += p
        best[path[-1]] = max(best[path[-1]], p)
    return total, best


def test_hidden_states_against_all_paths():
    pi, a, mu, sd = [0.5, 0.3, 0.2], [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]], [0.0, 2.0, 5.0], [1.0, 0.7, 2.0]
    values = [0.3, 1.8, 4.1, 5.5, 2.2, -0.4]
    rows = [(v, pi, sum(a, []), mu, sd) for v in values]
    step = recurrences.HiddenStates()
    _, made = step.step(step.start(), rows)
    for t in range(len(values)):
        total, best = _filtered(values[: t + 1], pi, a, mu, sd)
        assert made[t][0] == pytest.approx(total[2] / total.sum()) and made[t][3] == pytest.approx(math.log(total.sum()))
        assert made[t][1] == int(max(range(3), key=lambda s: best[s]) == 2)
    state, _ = step.step(step.start(), rows[:3])
    assert np.allclose(np.array(step.step(state, rows[3:])[1], float), np.array(made[3:], float))
    assert step.step(state, [(1.0, None, None, None, None)])[1] == [(None,) * 4]


def test_semantic_cache():
    """Against an ordered dictionary that is searched row by row, in pieces that go through the typed state."""
    from collections import OrderedDict

    rng = random.Random(6)
    words = "refund order ship late card pay login reset".split()
    rows, now = [], 0
    for i in range(400):
        now += rng.choice([1, 5, 30, 200]) * 1_000_000
        text = rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), "The " + rng.choice(words)])
        rows.append((now, text, rng.choice([None, f"answer {i}"])))
    step = recurrences.SemanticCache(0.9, 6, 900.0, ("the",))
    state, got = step.start(), []
    for part in np.array_split(np.arange(400), 23):
        state, made = step.step(state, [rows[i] for i in part])
        got += made
    held, n = OrderedDict(), {"hits": 0, "misses": 0, "evicted": 0, "expired": 0}

    def vector(text):
        w = [x for x in (text or "").lower().split() if x != "the"]
        return {x: 1 + math.log(w.count(x)) for x in w}

    for (at, text, answer), r in zip(rows, got):
        for k in [k for k, (_, t, _) in held.items() if at - t > 900_000_000]:
            del held[k]
            n["expired"] += 1
        mine, best, which = vector(text), 0.0, None
        for k, (_, _, other) in held.items():
            norms = math.sqrt(sum(x * x for x in mine.values())) * math.sqrt(sum(x * x for x in other.values()))
            like = sum(x * other.get(w, 0) for w, x in mine.items()) / norms if norms else 0.0
            if like > best + 1e-12:
                best, which = like, k
        hit = which is not None and best >= 0.9
        assert r[0] == hit and r[2] == pytest.approx(best)
        if hit:
            held.move_to_end(which)
            assert r[1] == held[which][0]
        n["hits" if hit else "misses"] += 1
        if not hit and answer is not None:
            held[at, answer] = (answer, at, mine)
            if len(held) > 6:
                held.popitem(last=False)
                n["evicted"] += 1
        assert r[3:] == (len(held), *n.values())
    assert min(n.values()) > 5


def test_session_memory():
    step = recurrences.SessionMemory(2, 10.0)
    s = 1_000_000
    state, made = step.step(step.start(), [(0, "a"), (1 * s, "b"), (2 * s, "a")])
    state, more = step.step(state, [(3 * s, None), (14 * s, "a"), (14 * s, "a")])
    assert made + more == [([], True, False, 1), (["a"], False, False, 2), (["a", "b"], False, True, 3), (["b", "a"], False, False, 4), ([], True, False, 1), (["a"], False, True, 2)]


def test_scan_keys_and_nulls(spark):
    rows = [(None, i, float(i)) for i in range(5)] + [("a", i, None if i == 2 else float(i % 3)) for i in range(40)] + [("b", 1, 7.0)]
    df = spark.createDataFrame(rows, "k string, o long, v double").withColumns({"m": F.lit(1.0), "s": F.lit(1.0)})
    got = {(r.k, r.o): r for r in recurrences.scan(df, ["k"], ["o"], ["v", "m", "s"], recurrences.ControlChart()).collect()}
    assert len(got) == len(rows) and got["a", 2].z is None and got["a", 2].rule is None
    want = quality_control.shewhart(df.filter("v IS NOT NULL"), ["k"], "o", "v", F.lit(1.0), F.lit(1.0)).collect()
    assert all(got[r.k, r.o].rule == r.rule and got[r.k, r.o].z == r.z for r in want)
    assert recurrences.scan(df.filter("false"), ["k"], ["o"], ["v", "m", "s"], recurrences.ControlChart()).count() == 0


def _series(spark):
    """Three keys, 150 rows each, with ties in time; and calibrated parameters."""
    rng = random.Random(3)
    rows = []
    for k in ("a", "b", "c"):
        for i in range(150):
            at = START + dt.timedelta(minutes=10 * (i // 2))
            level = 10 + 5 * math.sin(i / 4) + (15 if i > 100 else 0)
            rows.append((k, at, i, level + rng.gauss(0, 2), float(rng.random()), int(i < 80)))
    return spark.createDataFrame(rows, "k string, ts timestamp, i long, v double, w double, y int")


STEPS = {
    "chart": (recurrences.ControlChart(), ["v", "m", "s"]),
    "season": (recurrences.SeasonalResidual(6), ["v", "season", "start", "m", "s"]),
    "states": (recurrences.HiddenStates(), ["v", "pi", "a", "mu", "sd"]),
    "cache": (recurrences.SemanticCache(0.9, 3, 600.0), ["us", "said", "reply"]),
    "learner": (recurrences.OnlineLearner(2, grace=20, delta=0.05), ["y", "v", "w"]),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_streams_give_what_batches_give(spark, tmp_path, name):
    step, inputs = STEPS[name]
    df = _series(spark)
    df = df.withColumns({"us": F.unix_micros("ts"), "said": F.concat_ws(" ", F.lit("point"), (F.col("i") % 7).cast("string"), F.lit("is 22")), "reply": F.concat(F.lit("r"), F.col("i").cast("string"))})
    params = df.groupBy("k").agg(F.lit(12.0).alias("m"), F.lit(4.0).alias("s"), F.array(*[F.lit(float(x)) for x in (1, 2, 3, -1, -2, -3)]).alias("season"), F.lit(2).alias("start"))
    params = params.join(timeseries.hmm_parameters(df.filter("i < 60"), ["k"], "i", "v"), "k")
    params.write.parquet(str(tmp_path / "params"))
    params = spark.read.parquet(str(tmp_path / "params"))
    rows = df.collect()
    rng, parts = random.Random(5), [[] for _ in range(4)]
    for r in rows:  # up to two hours late, some delivered twice
        when = min(3, int((r.i // 2 * 10 + rng.randrange(120)) // 220))
        parts[when].append(r)
        if rng.random() < 0.1:
            parts[min(3, when + rng.randrange(2))].append(r)
    parts.append([("end", START + dt.timedelta(days=30), 0, 0.0, 0.0, 0, 0, "", None)])  # moves the watermark past all
    for p, part in enumerate(parts):
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{p}"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = stateful.scan_stream(stream.join(F.broadcast(params), "k", "left"), ["k"], "ts", "i", inputs, step, late="6 hours")
        q = out.writeStream.format("memory").queryName(f"online_{name}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = spark.sql(f"SELECT * FROM online_{name} WHERE k <> 'end'").withColumnRenamed("tie", "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    batch = recurrences.scan(df.join(params, "k"), ["k"], ["ts", "i"], inputs, step).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.k, r.i)
    for a, b in zip(sorted(got, key=key), sorted(batch, key=key)):
        for c in b.asDict():
            assert a[c] == b[c] if not isinstance(b[c], float) else a[c] == pytest.approx(b[c])
    if name == "learner":
        assert max(r.drifts for r in got) > 0
