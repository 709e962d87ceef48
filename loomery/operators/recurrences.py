"""Recurrences along a key's rows in order: one step function, run in batch here and on streams in ``streaming.stateful``.

A recurrence keeps a small typed state per key and gives one result per row. In batch, rows are dealt by key, sorted, and
stream through the tasks batch by batch: a task holds one batch and one state, never a key's rows. Keys run in parallel;
a key is sequential by definition.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Recurrence(Protocol):
    """What a recurrence offers. ``state`` and ``out`` are DDL; states and results are tuples in their order."""

    state: str
    out: str

    def start(self) -> tuple: ...

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state after these rows (tuples of the inputs, in order), and a result for each."""
        ...


def scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], recurrence: Recurrence) -> DataFrame:
    """``df``'s ``keys`` and ``order``, with the recurrence's results for each row. Null keys are a key like others; no rows: no rows."""
    named = {f.name: f for f in df.schema.fields}
    kept = list(dict.fromkeys([*keys, *order]))
    read = list(dict.fromkeys([*kept, *inputs]))
    out = StructType([named[c] for c in kept] + StructType.fromDDL(recurrence.out).fields)
    names = [f.name for f in out.fields][len(kept) :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, recurrence.start()
        for batch in batches:
            if not len(batch):
                continue
            key = list(zip(*(batch[k].astype(object).where(batch[k].notna(), None) for k in keys)))
            starts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            rows = list(zip(*(_plain(batch[c]) for c in inputs)))
            made: list[tuple] = []
            for a, b in zip(starts, starts[1:]):
                if last is None or key[a] != last:
                    last, state = key[a], recurrence.start()
                state, results = recurrence.step(state, rows[a:b])
                made += results
            yield pd.concat([batch[kept].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    return df.select(*read).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out)


def _plain(column: pd.Series) -> list:
    """Values with None for missing ones, arrays as lists."""
    return [None if v is None or (isinstance(v, float) and math.isnan(v)) else v.tolist() if isinstance(v, np.ndarray) else v for v in column]


# -- control charts ------------------------------------------------------------------------------------------------
class ControlChart:
    """Western Electric rules against given limits, with a ring of the last eight points. Inputs: value, mean, std.

    ``rule``: 1 beyond three deviations, 2 two of three beyond two on a side, 3 four of five beyond one, 4 eight on a
    side; the first that holds, else 0. Rows without value or limits give nulls and leave the ring as it is.
    """

    state = "ring array<double>, n bigint, violations bigint"
    out = "z double, rule int, violations bigint"

    def start(self) -> tuple:
        return [], 0, 0

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        ring, n, bad = list(state[0]), state[1], state[2]
        made = []
        for value, mean, std in rows:
            if value is None or mean is None or std is None:
                made.append((None, None, bad))
                continue
            z = (value - mean) / std
            ring, n = [*ring[-7:], z], n + 1
            rule = self._rule(ring)
            bad += rule > 0
            made.append((z, rule, bad))
        return (ring, n, bad), made

    @staticmethod
    def _rule(ring: list[float]) -> int:
        if abs(ring[-1]) > 3:
            return 1
        # Of the last so many points, so many beyond so many deviations on one side.
        for rule, last, need, limit in ((2, 3, 2, 2.0), (3, 5, 4, 1.0), (4, 8, 8, 0.0)):
            tail = ring[-last:]
            if len(tail) == last and max(sum(z > limit for z in tail), sum(z < -limit for z in tail)) >= need:
                return rule
        return 0


# -- seasons -------------------------------------------------------------------------------------------------------
class SeasonalResidual:
    """Distance of each value from trend and season. Inputs: value, season (array by phase), start (phase of the key's first row), mean and deviation of residuals.

    The trend is the mean of the last ``period`` values, kept in a ring. ``score`` is ``z / (z + limit)``: a half at the
    limit. Null values give nulls, and their place in the season passes.
    """

    state = "ring array<double>, n bigint"
    out = "trend double, seasonal double, residual double, score double, is_anomaly boolean"

    def __init__(self, period: int, limit: float = 3.0):
        self.period, self.limit = period, limit

    def start(self) -> tuple:
        return [], 0

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        ring, n, made = list(state[0]), state[1], []
        for value, season, start, mean, std in rows:
            phase, n = (int(start or 0) + n) % self.period, n + 1
            if value is None or season is None:
                made.append((None,) * 5)
                continue
            ring = [*ring[-(self.period - 1) :], float(value)] if self.period > 1 else [float(value)]
            trend, seasonal = math.fsum(ring) / len(ring), season[phase]
            residual = value - trend - seasonal
            z = abs(residual - mean) / std
            made.append((trend, seasonal, residual, z / (z + self.limit), z > self.limit))
        return (ring, n), made


def seasonal_profile(decomposed: DataFrame, groups: list[str], order: str, period: int) -> DataFrame:
    """What :class:`SeasonalResidual` needs per group, from a decomposition with ``seasonal`` and ``residual``: ``season`` (by phase), ``start`` (rows seen, modulo the period), ``mean`` and ``std`` (robust) of residuals.

    ``decomposed`` comes from ``timeseries.seasonal_decompose``. Each group's rows are counted by buckets of equal
    ``order`` only where needed: the phase is the row's rank modulo ``period``.
    """
    from pyspark.sql import Window

    ranked = decomposed.withColumn("_p", (F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1) % period)
    phases = ranked.groupBy(*groups, "_p").agg(F.first("seasonal").alias("s"), F.count(F.lit(1)).alias("n"))
    season = phases.groupBy(*groups).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "s"))), lambda x: x["s"]).alias("season"), (F.sum("n") % period).alias("start"))  # a period's values
    middle = decomposed.groupBy(*groups).agg(F.median("residual").alias("mean"))
    spread = decomposed.join(middle, groups).groupBy(*groups).agg(F.first("mean").alias("mean"), F.greatest(F.lit(1e-8), 1.4826 * F.median(F.abs(F.col("residual") - F.col("mean")))).alias("std"))
    return season.join(spread, groups)


# -- hidden states -------------------------------------------------------------------------------------------------
class HiddenStates:
    """Forward filter of a Gaussian hidden Markov model, in logarithms. Inputs: value, and the calibrated ``pi``, ``a`` (row by row), ``mu``, ``sd`` as arrays.

    ``posterior``: chance of the state with the greatest mean after the value, given all values up to it; ``likely``: 1
    if the best path so far ends in that state; ``log_likelihood`` of all values up to this one. A null value passes
    time without evidence. Models may have any number of states.
    """

    state = "forward array<double>, best array<double>, log_likelihood double"
    out = "posterior double, likely int, is_anomaly boolean, log_likelihood double"

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold

    def start(self) -> tuple:
        return [], [], 0.0

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        forward, best, total = np.array(state[0], float), np.array(state[1], float), float(state[2])
        made, known = [], None
        for value, pi, a, mu, sd in rows:
            if pi is None:
                made.append((None,) * 4)
                continue
            if known != (pi, a, mu, sd):
                known, k = (pi, a, mu, sd), len(pi)
                with np.errstate(divide="ignore"):
                    log_pi, log_a = np.log(np.array(pi)), np.log(np.array(a).reshape(k, k))
                mus, sds, high = np.array(mu), np.array(sd), int(np.argmax(mu))
            emit = np.zeros(k) if value is None else -0.5 * ((value - mus) / sds) ** 2 - np.log(sds) - 0.5 * math.log(2 * math.pi)
            first = not len(forward)
            forward = emit + (log_pi if first else np.logaddexp.reduce(forward[:, None] + log_a, axis=0))
            best = emit + (log_pi if first else (best[:, None] + log_a).max(axis=0))
            scale = float(np.logaddexp.reduce(forward))
            total, forward, best = total + scale, forward - scale, best - best.max()
            p = float(np.exp(forward[high]))
            made.append((p, int(best.argmax() == high), p > self.threshold, total))
        return (forward.tolist(), best.tolist(), total), made


# -- learning with drift -------------------------------------------------------------------------------------------
class AdaptiveWindow:
    """ADWIN (Bifet and Gavalda, 2007): a window over a sequence that drops its older part when the two parts' means differ.

    The window is kept as buckets of 1, 2, 4, ... values, oldest first, ``per_size`` of each size at most: logarithmic in
    its length. All borders between buckets are tried every ``clock`` values.
    """

    def __init__(self, sizes=(), sums=(), squares=(), since: int = 0, delta: float = 0.002, clock: int = 32, per_size: int = 5, least: int = 5):
        self.sizes, self.sums, self.squares, self.since = list(sizes), list(sums), list(squares), since
        self.delta, self.clock, self.per_size, self.least = delta, clock, per_size, least

    @property
    def width(self) -> int:
        return sum(self.sizes)

    @property
    def mean(self) -> float:
        return math.fsum(self.sums) / self.width if self.sizes else 0.0

    def add(self, value: float) -> bool:
        """Take a value; true if the window was cut."""
        for kept, new in ((self.sizes, 1), (self.sums, value), (self.squares, value * value)):
            kept.append(new)
        self._compress()
        self.since += 1
        if self.since % self.clock or self.width <= 2 * self.least:
            return False
        cut = False
        while len(self.sizes) > 1 and self._differs():
            cut = True
            for kept in (self.sizes, self.sums, self.squares):
                del kept[0]
        return cut

    def _compress(self) -> None:
        size, end = 1, len(self.sizes)
        while True:
            start = end
            while start and self.sizes[start - 1] == size:
                start -= 1
            if end - start <= self.per_size:
                return
            for kept in (self.sizes, self.sums, self.squares):  # the two oldest of this size become one of the next
                kept[start : start + 2] = [kept[start] + kept[start + 1]]
            size, end = 2 * size, start + 1

    def _differs(self) -> bool:
        n, total = self.width, math.fsum(self.sums)
        variance = max(0.0, math.fsum(self.squares) / n - (total / n) ** 2)
        strict = math.log(2 * math.log(n) / self.delta) if n > 1 else 0.0
        old, old_sum = 0, 0.0
        for size, part in zip(self.sizes[:-1], self.sums[:-1]):
            old, old_sum = old + size, old_sum + part
            if old < self.least or n - old < self.least:
                continue
            m = 1 / old + 1 / (n - old)
            if abs(old_sum / old - (total - old_sum) / (n - old)) > math.sqrt(2 * m * variance * strict) + 2 / 3 * m * strict:
                return True
        return False


#: Numbers kept for each class and feature in a leaf: count, mean, sum of squared deviations, least, greatest.
_KEPT = 5


class GrowingTree:
    """A Hoeffding tree for two classes (Domingos and Hulten, 2000), with Gaussian features and naive Bayes in its leaves.

    Nodes are flat arrays: ``feature`` (-1 for a leaf), ``cut``, ``left``, ``right``, ``leaf`` (place of a leaf's numbers).
    """

    def __init__(self, n_features: int, nodes=None, priors=None, stats=None, asked=None, grace: int = 100, delta: float = 1e-7, tie: float = 0.05, cuts: int = 10, max_leaves: int = 256):
        self.n = n_features
        self.feature, self.cut, self.left, self.right, self.leaf = nodes or ([-1], [0.0], [-1], [-1], [0])
        self.priors = priors if priors is not None else np.zeros((1, 2))  # rows of each class, those expected from above included
        self.stats = stats if stats is not None else self._empty(1)
        self.asked = asked if asked is not None else [0.0]  # rows when a split was last tried
        self.grace, self.delta, self.tie, self.cuts, self.max_leaves = grace, delta, tie, cuts, max_leaves

    def _empty(self, k: int) -> np.ndarray:
        out = np.zeros((k, 2, self.n, _KEPT))
        out[..., 3], out[..., 4] = np.inf, -np.inf
        return out

    def find(self, x: np.ndarray) -> int:
        """The node of the leaf that a row falls into."""
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if x[self.feature[at]] <= self.cut[at] else self.right[at]
        return at

    def chance(self, x: np.ndarray) -> float:
        """The chance of class 1."""
        leaf = self.leaf[self.find(x)]
        prior, s = self.priors[leaf], self.stats[leaf]
        if not prior.sum():
            return 0.5
        log = np.full(2, -np.inf)
        for c in (0, 1):
            if prior[c]:
                n, variance = s[c, :, 0], s[c, :, 2] / np.maximum(s[c, :, 0], 1)
                ok = (n > 1) & (variance > 1e-12)
                v = np.where(ok, variance, 1.0)
                log[c] = math.log(prior[c] / prior.sum()) + float(np.where(ok, -0.5 * np.log(2 * np.pi * v) - (x - s[c, :, 1]) ** 2 / (2 * v), 0.0).sum())
        log -= log.max()
        return float(np.exp(log[1]) / np.exp(log).sum())

    def learn(self, x: np.ndarray, y: int) -> None:
        node = self.find(x)
        leaf = self.leaf[node]
        self.priors[leaf, y] += 1
        s = self.stats[leaf, y]
        s[:, 0] += 1
        off = x - s[:, 1]
        s[:, 1] += off / s[:, 0]
        s[:, 2] += off * (x - s[:, 1])
        s[:, 3], s[:, 4] = np.minimum(s[:, 3], x), np.maximum(s[:, 4], x)
        seen = self.priors[leaf].sum()
        if seen - self.asked[leaf] >= self.grace and self.priors[leaf].min() > 0 and len(self.priors) < self.max_leaves:
            self.asked[leaf] = seen
            self._try_split(node, leaf)

    def _below(self, leaf: int, f: int, t: float) -> np.ndarray:
        """Rows of each class expected at or below a cut."""
        out = np.zeros(2)
        for c in (0, 1):
            n, mean, squares, least, most = self.stats[leaf, c, f]
            if not n or t < least:
                continue
            sd = math.sqrt(squares / n)
            out[c] = n if t >= most or sd < 1e-12 else n * 0.5 * (1 + math.erf((t - mean) / (sd * math.sqrt(2))))
        return out

    def _try_split(self, node: int, leaf: int) -> None:
        totals = self.stats[leaf, :, 0, 0]

        def bits(n: np.ndarray) -> float:
            p = n[n > 0] / n.sum() if n.sum() else n[:0]
            return float(-(p * np.log2(p)).sum())

        found = [(0.0, -1, 0.0, None)]  # no split at all
        for f in range(self.n):
            low, high = self.stats[leaf, :, f, 3].min(), self.stats[leaf, :, f, 4].max()
            if not low < high:
                continue
            best = max(
                (
                    (bits(totals) - (below.sum() * bits(below) + (totals - below).sum() * bits(totals - below)) / totals.sum(), f, t, below)
                    for t in (low + (high - low) * i / (self.cuts + 1) for i in range(1, self.cuts + 1))
                    for below in [self._below(leaf, f, t)]
                ),
                key=lambda g: g[0],
            )
            found.append(best)
        found.sort(key=lambda g: -g[0])
        bound = math.sqrt(math.log(1 / self.delta) / (2 * totals.sum()))
        gain, f, t, below = found[0]
        if f < 0 or len(found) < 2 or (gain - found[1][0] <= bound and bound >= self.tie):
            return
        new = len(self.priors)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = f, t, len(self.feature), len(self.feature) + 1
        self.feature += [-1, -1]
        self.cut += [0.0, 0.0]
        self.left += [-1, -1]
        self.right += [-1, -1]
        self.leaf += [leaf, new]
        self.leaf[node] = -1
        self.priors = np.vstack([self.priors, totals - below])
        self.priors[leaf] = below
        self.stats = np.concatenate([self.stats, self._empty(1)])
        self.stats[leaf] = self._empty(1)[0]
        self.asked[leaf] = float(below.sum())
        self.asked.append(float((totals - below).sum()))


class OnlineLearner:
    """Predict, then learn: a growing tree on standardised features, its errors watched by an adaptive window. Inputs: label (0 or 1), then the features.

    ``chance`` of class 1 and ``prediction`` come before the row is learned. ``drift``: the window was cut at this row.
    A missing feature counts as its mean so far; a row without label is predicted and not learned (``error`` is null).
    The whole model is the key's state, in typed arrays; it grows with the tree, ``max_leaves`` at most.
    """

    state = (
        "n bigint, drifts bigint, since bigint, count array<double>, mean array<double>, squares array<double>, feature array<int>, cut array<double>, left array<int>, right array<int>, leaf array<int>, "
        "priors array<double>, stats array<double>, asked array<double>, sizes array<bigint>, sums array<double>, second array<double>, clock bigint"
    )
    out = "chance double, prediction int, error double, drift boolean, error_rate double, seen bigint, drifts bigint, since_drift bigint"

    def __init__(self, n_features: int, delta: float = 0.002, grace: int = 100, max_leaves: int = 256):
        self.n, self.delta, self.grace, self.max_leaves = n_features, delta, grace, max_leaves

    def start(self) -> tuple:
        zero = [0.0] * self.n
        tree = GrowingTree(self.n)
        return (0, 0, 0, zero, zero, zero, *self._flat(tree), [], [], [], 0)

    @staticmethod
    def _flat(tree: GrowingTree) -> tuple:
        whole = lambda x: [int(v) for v in x]
        return whole(tree.feature), [float(v) for v in tree.cut], whole(tree.left), whole(tree.right), whole(tree.leaf), tree.priors.ravel().tolist(), tree.stats.ravel().tolist(), [float(v) for v in tree.asked]

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        n, drifts, since, count, mean, squares, *rest = state
        nodes, (priors, stats, asked, sizes, sums, second, clock) = [list(x) for x in rest[:5]], rest[5:]
        tree = GrowingTree(self.n, nodes, np.array(priors, float).reshape(-1, 2), np.array(stats, float).reshape(-1, 2, self.n, _KEPT), list(asked), self.grace, max_leaves=self.max_leaves)
        window = AdaptiveWindow(sizes, sums, second, clock, self.delta)
        count, mean, squares = (np.array(x, float) for x in (count, mean, squares))
        made = []

        def scaled(x: np.ndarray) -> np.ndarray:
            sd = np.sqrt(squares / np.maximum(count, 1))
            return np.where(np.isnan(x) | (sd < 1e-12), 0.0, (x - mean) / np.where(sd < 1e-12, 1.0, sd))

        for label, *features in rows:
            x = np.array([math.nan if v is None else float(v) for v in features])
            chance = tree.chance(scaled(x))
            guess = int(chance > 0.5)
            if label is None:
                made.append((chance, guess, None, False, window.mean, n, drifts, since))
                continue
            error = float(guess != int(label))
            drift = window.add(error)
            drifts, since = drifts + drift, 0 if drift else since
            there = ~np.isnan(x)
            count = count + there
            off = np.where(there, x - mean, 0.0)
            mean = mean + off / np.maximum(count, 1)
            squares = squares + off * np.where(there, x - mean, 0.0)
            tree.learn(scaled(x), int(label))
            n, since = n + 1, since + 1
            made.append((chance, guess, error, drift, window.mean, n, drifts, since))
        return (n, drifts, since, count.tolist(), mean.tolist(), squares.tolist(), *self._flat(tree), window.sizes, window.sums, window.squares, window.since), made


# -- caches --------------------------------------------------------------------------------------------------------
class SemanticCache:
    """Answers kept by similar queries, with a time to live and a bounded size. Inputs: time (microseconds), query, answer.

    A query is compared with all that are kept, by cosine of word weights ``1 + log(count)`` (words of two or more word
    characters, lower-cased, without ``stop_words``). From ``threshold`` on the most similar, of equal ones the least
    recently used, is a hit: its answer is given and it is the most recent one again. Else the row's own answer, if it has
    one, is kept; beyond ``entries`` the least recently used goes. What is older than ``ttl`` seconds goes before each row.
    Null queries count as empty ones, which are like nothing.
    """

    state = "queries array<string>, answers array<string>, made array<bigint>, hits bigint, misses bigint, evicted bigint, expired bigint"
    out = "hit boolean, answer string, similarity double, entries int, hits bigint, misses bigint, evicted bigint, expired bigint"

    def __init__(self, threshold: float = 0.85, entries: int = 100, ttl: float = 3600.0, stop_words: tuple[str, ...] = ()):
        self.threshold, self.entries, self.ttl, self.stop_words = threshold, entries, int(ttl * 1e6), frozenset(stop_words)

    def start(self) -> tuple:
        return [], [], [], 0, 0, 0, 0

    def weights(self, text: str | None) -> dict[str, float]:
        """A query's word weights, of length 1."""
        counts: dict[str, int] = {}
        for w in re.findall(r"\w{2,}", (text or "").lower()):
            if w not in self.stop_words:
                counts[w] = counts.get(w, 0) + 1
        found = {w: 1 + math.log(c) for w, c in counts.items()}
        length = math.sqrt(math.fsum(x * x for x in found.values())) or 1.0
        return {w: x / length for w, x in found.items()}

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        hits, misses, evicted, expired = state[3:]
        kept = [(q, a, t, self.weights(q)) for q, a, t in zip(*state[:3])]  # the least recently used first
        made = []
        for now, query, answer in rows:
            live = [x for x in kept if now - x[2] <= self.ttl]
            expired += len(kept) - len(live)
            kept, mine = live, self.weights(query)
            like = [math.fsum(x * other[3].get(w, 0.0) for w, x in mine.items()) for other in kept]
            best = max(range(len(kept)), key=lambda i: (like[i], -i), default=None)
            similarity = like[best] if best is not None else 0.0
            if best is not None and similarity >= self.threshold and mine:
                hits += 1
                kept.append(kept.pop(best))
                made.append((True, kept[-1][1], similarity, len(kept), hits, misses, evicted, expired))
                continue
            misses += 1
            if answer is not None:
                kept.append((query, answer, now, mine))
                if len(kept) > self.entries:
                    del kept[0]
                    evicted += 1
            made.append((False, None, similarity, len(kept), hits, misses, evicted, expired))
        return ([x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept], hits, misses, evicted, expired), made


class SessionMemory:
    """The last items of a session: what a recommender needs to know of it. Inputs: time (microseconds), item.

    ``recent``: up to ``last`` items before this one, oldest first; ``cold`` if there are none, because the session is
    new or ``idle`` seconds passed; ``seen`` if the item is among them; ``length``: items of the session, this one included.
    """

    state = "items array<string>, last bigint, length bigint"
    out = "recent array<string>, cold boolean, seen boolean, length bigint"

    def __init__(self, last: int = 20, idle: float = 1800.0):
        self.last, self.idle = last, int(idle * 1e6)

    def start(self) -> tuple:
        return [], 0, 0

    def step(self, state: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        items, before, length = list(state[0]), state[1], state[2]
        made = []
        for now, item in rows:
            if length and now - before > self.idle:
                items, length = [], 0
            item = None if item is None else str(item)
            length += 1
            made.append((list(items), not items, item in items, length))
            items, before = [*items, item][-self.last :], now
        return (items, before, length), made
