"""Exact centroid clustering by ball-tree filtering (operator 13).

Vectors become integers, ``floor(scale * x)``, so that every sum, mean and distance is exact and does not depend on the
order of rows or tasks. They are written once as *trees*: each row of the staged table is a metric tree over a few
thousand vectors that stood in one partition, with radius, count and integer sum of every ball. A round sends the
few centroids to all tasks and walks the trees level by level, all balls of a level at once:

- a centroid is dropped for a ball if it is farther from every point of it than the nearest one is from any, by the
  triangle inequality, with room for rounding; so no tie is ever decided here;
- a ball with one centroid left gives its count and sum as a whole;
- the others descend; leaves compare their points with the centroids left, in exact integers.

A tree gives back one row per centroid, with sums as exact decimals in text; they are added up in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.session import stage_table

#: Vectors of a tree, and of a leaf.
TREE_ROWS, LEAF_ROWS = 4096, 24
#: Up to this size of integers, products and sums of a distance are exact in double precision (fixed: 2 ** 20 squared, 4 times, by 1024 components is 2 ** 52).
EXACT_BOUND = 1 << 20


# -- one tree, on the integers of a chunk of vectors ---------------------------------------------------------------
class Tree:
    """A metric tree. ``order`` sorts the points so that each ball is a stretch ``first`` to ``last``; a leaf's children are -1."""

    def __init__(self, points: np.ndarray, wide: bool, leaf: int = LEAF_ROWS):
        """``points``: integers, float64 unless ``wide``, where they are Python's. A wide tree is one leaf."""
        n, self.wide = len(points), wide
        order = np.arange(n)
        first, last, left, right, level = [0], [n], [-1], [-1], [[0]]
        while not wide and level[-1]:
            below = []
            for node in level[-1]:
                a, b = first[node], last[node]
                if b - a <= leaf:
                    continue
                mine = points[order[a:b]]
                # the two ends of the ball: the farthest from its middle, and the farthest from that
                one = mine[np.argmax(((mine - mine.mean(axis=0)) ** 2).sum(axis=1))]
                to_one = ((mine - one) ** 2).sum(axis=1)
                two = mine[np.argmax(to_one)]
                if not to_one.max():
                    continue  # equal points
                side = to_one - ((mine - two) ** 2).sum(axis=1)
                cut = int((side < 0).sum())
                cut = cut if leaf // 4 < cut < b - a - leaf // 4 else (b - a) // 2
                order[a:b] = order[a:b][np.argsort(side, kind="stable")]
                for s, e in ((a, a + cut), (a + cut, b)):
                    below.append(len(first))
                    first.append(s), last.append(e), left.append(-1), right.append(-1)
                left[node], right[node] = below[-2], below[-1]
            level.append(below)
        self.order, self.points = order, points[order]
        self.first, self.last, self.left, self.right = (np.array(x, np.int64) for x in (first, last, left, right))
        self.levels = [np.array(x, np.int64) for x in level if x]
        if not wide:
            total = np.concatenate([np.zeros((1, points.shape[1])), np.cumsum(self.points, axis=0)])
            self.sums = total[self.last] - total[self.first]
            self.middles = self.sums / (self.last - self.first)[:, None]
            self.radii = np.array([np.sqrt(((self.points[a:b] - m) ** 2).sum(axis=1).max()) for a, b, m in zip(first, last, self.middles)])

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Per point (in tree order) its centroid's number; per centroid count and sum of its points; how many distances of points were needed."""
        k, n = len(centroids), len(self.points)
        number = np.zeros(n, np.int64)
        if self.wide:
            far = np.array([[sum((x - c) ** 2 for x, c in zip(p, q)) for q in centroids] for p in self.points], object).reshape(n, k)
            number = np.array([min(range(k), key=lambda c, d=d: (d[c], c)) for d in far], np.int64)
            sums = [[sum(self.points[number == c, j].tolist()) for j in range(self.points.shape[1])] for c in range(k)]
            return number, np.bincount(number, minlength=k), np.array(sums, object), n * k
        counts, sums, tried = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1])), 0
        squares = (centroids**2).sum(axis=1)
        asked, possible = self.levels[0], np.ones((1, k), bool)
        while len(asked):
            middle = self.middles[asked]
            d = np.sqrt(np.maximum((middle**2).sum(axis=1)[:, None] - 2 * middle @ centroids.T + squares, 0))
            d[~possible] = np.inf
            radius = self.radii[asked]
            scale = 1 + np.abs(self.points).max(initial=0) + np.abs(centroids).max(initial=0)
            room = 1e-5 * scale  # far above the rounding of d, whose squares lose 1e-14 of scale ** 2 by component
            possible = d <= (d.min(axis=1) + 2 * radius + room)[:, None]
            sure = possible.sum(axis=1) == 1
            for node, c in zip(asked[sure], possible[sure].argmax(axis=1)):
                number[self.first[node] : self.last[node]] = c
                counts[c] += self.last[node] - self.first[node]
                sums[c] += self.sums[node]
            leaf = ~sure & (self.left[asked] < 0)
            for node, may in zip(asked[leaf], possible[leaf]):
                a, b = self.first[node], self.last[node]
                some = np.flatnonzero(may)
                mine = self.points[a:b]
                number[a:b] = some[(squares[some] - 2 * mine @ centroids[some].T).argmin(axis=1)]  # exact; the first of equal ones
                tried += (b - a) * len(some)
                counts += np.bincount(number[a:b], minlength=k)
                np.add.at(sums, number[a:b], mine)
            down = ~sure & ~leaf
            asked, possible = np.stack([self.left[asked[down]], self.right[asked[down]]], axis=1).ravel(), np.repeat(possible[down], 2, axis=0)
        return number, counts, sums, tried


_BALLS = ["wide", "dims", "bytes", "points", "radii", "sums", "nodes", "level_sizes"]
_TREE_FIELDS = "ids array<{id}>, wide boolean, dims int, bytes int, points binary, radii binary, sums binary, nodes binary, level_sizes array<int>"


def _stored(tree: Tree, ids: list, dims: int) -> dict:
    """A tree as a row: points in as many bytes as they need, counts as stretches. Points of a wide tree are decimals in text."""
    ids = [ids[i] for i in tree.order]
    if tree.wide:
        text = ",".join(str(x) for p in tree.points for x in p).encode()
        return {"ids": ids, "wide": True, "dims": dims, "bytes": 0, "points": text, "radii": b"", "sums": b"", "nodes": b"", "level_sizes": []}
    most = np.abs(tree.points).max(initial=0)
    size = 1 if most < 128 else 2 if most < 1 << 15 else 4
    nodes = np.stack([tree.first, tree.last, tree.left, tree.right]).astype(np.int32)
    return {
        "ids": ids, "wide": False, "dims": dims, "bytes": size, "points": tree.points.astype(f"i{size}").tobytes(), "radii": tree.radii.tobytes(),
        "sums": tree.sums.astype(np.int64).tobytes(), "nodes": nodes.tobytes(), "level_sizes": [len(x) for x in tree.levels],
    }


def _loaded(row: dict) -> Tree:
    tree = Tree.__new__(Tree)
    tree.wide, dims = row["wide"], row["dims"]
    if tree.wide:
        tree.points = np.array([int(x) for x in row["points"].decode().split(",")], object).reshape(-1, dims)
        return tree
    tree.points = np.frombuffer(row["points"], f"i{row['bytes']}").astype(np.float64).reshape(-1, dims)
    tree.first, tree.last, tree.left, tree.right = np.frombuffer(row["nodes"], np.int32).astype(np.int64).reshape(4, -1)
    tree.sums = np.frombuffer(row["sums"], np.int64).astype(np.float64).reshape(-1, dims)
    tree.middles = tree.sums / (tree.last - tree.first)[:, None]
    tree.radii = np.frombuffer(row["radii"], np.float64)
    ends = np.cumsum(row["level_sizes"])
    tree.levels = [np.arange(b - n, b) for b, n in zip(ends, row["level_sizes"])]  # nodes are numbered level by level
    return tree


# -- Spark ---------------------------------------------------------------------------------------------------------
def _kept(vec: Column, dims: int) -> Column:
    """True for a vector with exactly ``dims`` components, none of them null, NaN or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vec) == dims) & ~F.exists(vec.cast("array<double>"), bad), F.lit(False))


def _integers(values: np.ndarray, scale: int) -> tuple[np.ndarray, bool]:
    """``floor(scale * x)`` of doubles; and whether they need Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not len(values) or np.abs(scaled).max() <= EXACT_BOUND:
        return scaled, False
    # doubles are fractions: exact for any size of them
    parts = [[v.as_integer_ratio() for v in row] for row in values.tolist()]
    return np.array([[(a * scale) // b for a, b in row] for row in parts], object), True


def build_trees(vectors: DataFrame, key: str, vec: str, dims: int, scale: int) -> DataFrame:
    """One row per tree over the vectors that pass ``_kept``: partition-local, nothing is shuffled."""
    id_type = vectors.schema[key].dataType.simpleString()
    schema = _TREE_FIELDS.format(id=id_type)
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def rows_of(ids: list, values: list) -> Iterator[dict]:
        points, _ = _integers(np.concatenate(values), scale)
        small = np.array([max(abs(x) for x in p) <= EXACT_BOUND for p in points]) if points.dtype == object else np.ones(len(points), bool)
        for chosen, wide in ((small, False), (~small, True)):
            if chosen.any():
                mine = points[chosen] if wide else points[chosen].astype(np.float64)
                yield _stored(Tree(mine, wide), [i for i, c in zip(ids, chosen) if c], dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = list(rows_of(ids, values))
            made = {n: [r[n] for r in rows] for n in rows[0]}
            kinds = {"ids": pa.list_(arrow_id[id_type]), "wide": pa.bool_(), "dims": pa.int32(), "bytes": pa.int32(), "level_sizes": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.binary())) for n, v in made.items()], names=list(made))

        for batch in batches:
            for start in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(start, TREE_ROWS)
                ids += part.column(0).to_pylist()
                values.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
                held += part.num_rows
                if held >= TREE_ROWS:
                    yield flush()
                    ids, values, held = [], [], 0
        if held:
            yield flush()

    if id_type not in arrow_id:
        raise ValueError(f"ids are bigint, int or string, not {id_type}")
    chosen = vectors.filter(_kept(F.col(vec), dims)).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return chosen.mapInArrow(run, schema)


def _over_trees(trees: DataFrame, centroids: list[list[int]], made, schema: str, columns: list[str]) -> DataFrame:
    """What ``made(row, tree, centroids)`` gives for each tree, as frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = all(abs(x) <= EXACT_BOUND for c in centroids for x in c)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in columns}
                tree = _loaded(row)
                if not fits and not tree.wide:  # centroids made of wide vectors: compare in Python's integers
                    tree.points, tree.wide = np.array([[int(x) for x in p] for p in tree.points], object), True
                yield made(row, tree, np.array(centroids, object if tree.wide else np.float64))

    return trees.select(*columns).mapInArrow(run, schema)


def _sums(trees: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and integer sum of each centroid's vectors, over all trees."""

    def made(row: dict, tree: Tree, at: np.ndarray) -> pa.RecordBatch:
        _, counts, sums, _ = tree.assign(at)
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), pa.array([[str(int(x)) for x in sums[c]] for c in some], pa.list_(pa.string()))],
            names=["cluster", "n", "total"],
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = [str(sum(int(x) for x in column)) for column in zip(*rows["total"])]
        return pd.DataFrame({"cluster": [rows["cluster"].iloc[0]], "n": [int(rows["n"].sum())], "total": [total]})

    schema = "cluster int, n bigint, total array<string>"
    parts = _over_trees(trees, centroids, made, schema, _BALLS)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("total"), F.lit(64))).groupBy("cluster", "salt")
    halves = salted.applyInPandas(lambda rows: add(rows), schema)
    return {r["cluster"]: (r["n"], [int(x) for x in r["total"]]) for r in halves.groupBy("cluster").applyInPandas(add, schema).collect()}  # a row per centroid


def first_centroids(vectors: DataFrame, key: str, vec: str, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` kept vectors with the smallest sha256 of ``seed:id``, as integers. Equal ids: by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    kept = vectors.filter(_kept(F.col(vec), dims)).select(digest.alias("h"), F.col(vec).cast("array<double>").alias("v"))
    rows = kept.orderBy("h", "v").limit(k).collect()
    points, wide = _integers(np.array([r["v"] for r in rows], np.float64).reshape(-1, dims), scale)
    return [[int(x) for x in p] for p in points]


def cluster(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Return (``key``, ``cluster``, ``distance``) per kept vector, and (``cluster``, ``centroid``, ``n``) per final centroid.

    A vector is kept if it has exactly ``dims`` components, none null, NaN or infinite; the others are left out. It
    becomes ``floor(scale * x)`` in doubles. Each of ``rounds`` rounds assigns every vector to its nearest centroid
    (squared Euclidean distance, the smaller number of equal ones) and moves every centroid that has vectors to their
    floored mean; empty ones stay. Then all are assigned once more. Results are exact integers, the same for any number
    of tasks. Vectors with integers above 2 ** 20 are compared one by one in Python's integers; a distance beyond a long
    is null. Null ids hash as empty ones, repeated rows count as often as they occur, other columns are ignored, fewer
    than ``k`` kept vectors make fewer centroids, and none give no rows.

    Trees are written once; a round reads them, moves ``k`` rows a tree, and sends ``k`` centroids to the tasks.
    """
    spark = vectors.sparkSession
    trees = stage_table(build_trees(vectors, key, vec, dims, scale), "trees")
    centroids = first_centroids(vectors, key, vec, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in _sums(trees, centroids).items():
            centroids[c] = [x // n for x in total]
    id_field = vectors.schema[key]
    id_type = trees.schema["ids"].dataType.elementType.simpleString()

    def made(row: dict, tree: Tree, at: np.ndarray) -> pa.RecordBatch:
        number, *_ = tree.assign(at)
        far = [sum((int(x) - int(y)) ** 2 for x, y in zip(p, at[c])) for p, c in zip(tree.points, number)] if tree.wide else ((tree.points - at[number]) ** 2).sum(axis=1).astype(np.int64)
        far = pa.array([d if d < 1 << 63 else None for d in far], pa.int64()) if tree.wide else pa.array(far)
        ids = pa.array(row["ids"], {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string()))
        return pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), far], names=["id", "cluster", "distance"])

    members = _over_trees(trees, centroids, made, f"id {id_type}, cluster int, distance bigint", ["ids", *_BALLS]).withColumnRenamed("id", id_field.name)
    final = spark.createDataFrame([(c, [str(x) for x in v]) for c, v in enumerate(centroids)], "cluster int, centroid array<string>")
    return members, final


def op13_clusters(vectors: DataFrame) -> DataFrame:
    """The contract's query: every kept vector with its cluster, distances summed over cluster and table, and a digest of its centroid."""
    members, final = cluster(vectors)
    total = lambda c: F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col(c).cast("decimal(38,0)"))).try_cast("bigint")
    by_cluster = members.groupBy("cluster").agg(total("distance").alias("cluster_inertia"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known"))
    whole = by_cluster.agg(F.when(F.sum("n") == F.sum("known"), F.sum(F.col("cluster_inertia").cast("decimal(38,0)"))).try_cast("bigint").alias("inertia"))
    about = final.select("cluster", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))
    # one row per centroid, and one row
    sums = F.broadcast(by_cluster.select("cluster", "cluster_inertia").join(F.broadcast(about), "cluster").crossJoin(F.broadcast(whole)))
    return members.join(sums, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """One round: assign all to the centroids of round ``i``, and move them."""
    return f"""
a{i} AS MATERIALIZED (SELECT v, arg_min(c, d * 100 + c) AS c, min(d) AS d FROM
    (SELECT x.v, c.c, CAST(list_sum(list_transform(generate_series(1, 64), lambda j: (x.q[j] - c.q[j]) * (x.q[j] - c.q[j]))) AS BIGINT) AS d FROM x, c{i} c) GROUP BY v),
m{i} AS MATERIALIZED (SELECT c, j, CAST(floor(sum(x.q[j]) / count(*)) AS BIGINT) AS q FROM a{i} JOIN x USING (v), range(1, 65) r(j) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT c, list(q ORDER BY j) AS q FROM m{i} GROUP BY c) m USING (c)),"""


OP13_SQL = (
    """
WITH x AS MATERIALIZED (SELECT vec_id AS v, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || v)) - 1 AS INTEGER) AS c, q FROM x QUALIFY c < 16),"""
    + "".join(map(_round_sql, range(4))).split("m3 AS")[0].rstrip().rstrip(",")
    + """
SELECT v AS vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)
"""
)
