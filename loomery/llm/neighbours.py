"""Near duplicates of embeddings by Euclidean p-stable hashing (operator 11).

Vectors are normalised, so that cosine ``c`` is the distance ``sqrt(2 - 2 c)``. A table's code is ``k`` quantised random
projections, ``floor((a x + b) / w)``; vectors with one code share a bucket and are compared by exact cosine. How many
projections a code has, and how many tables there are, follows from the number of vectors:

- ``k``: unrelated vectors (at a right angle) should meet about ``MEETINGS`` times in a table, a number of cosines that
  costs less than moving a vector to the table;
- the tables: a pair right at the threshold should meet in one at least with probability ``recall``; nearer pairs meet
  more surely.

Projections and vectors are rounded to integers whose sums are exact in double precision, so a code is the same wherever
and in whatever batch it is computed. Equal vectors are one node with a count. A bucket of more than ``BLOCK_ROWS``
nodes is dealt into blocks whose pairs go to different tasks, so that no bucket is cut and no task holds more than two
blocks. Pairs are never sent: a task gives back per node how many others it found there, and edges that span what is
connected. A pair is counted in the first of the tables in which it meets; that is decided from the two vectors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from loomery.operators.components import connected_components
from loomery.session import stage_table, tasks_for

#: Width of a quantisation step, in units of the sphere's radius. At 2, tables grow with the 0.27th power of the vectors.
WIDTH = 2.0
#: Unrelated vectors that a vector may meet in a table, about.
MEETINGS = 1024
#: Nodes of a block.
BLOCK_ROWS = 2048
#: Hot buckets or equal vectors up to this number are sent to every executor (16 to 40 bytes each); beyond it they are joined.
MAX_SENT = 200_000
#: Steps of the rounded vectors and projections: their products summed over 65536 components stay below 2 ** 53.
_X_STEP, _A_STEP = 1 << 18, 1 << 12


# -- the family of hashes ------------------------------------------------------------------------------------------
def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that two vectors at this distance agree in one projection (Datar et al., 2004)."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, recall: float, meetings: int = MEETINGS) -> tuple[int, int]:
    """Projections of a code and number of tables for ``n`` vectors."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * cosine)) if cosine < 1 else 1.0
    k = max(2, math.ceil(math.log(max(n, 1) / meetings) / -math.log(far)))
    hit = near**k
    return k, 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))


@functools.lru_cache(maxsize=8)
def _family(dims: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dims x tables * k) and shifts, rounded to integers."""
    rng = np.random.default_rng([seed, dims])
    a = np.rint(rng.standard_normal((tables * k, dims)).T * _A_STEP)
    return a, np.floor(rng.random(tables * k) * WIDTH * _A_STEP * _X_STEP)


def codes(unit: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector (rows, of length 1) in each table, as 64-bit numbers."""
    a, b = _family(unit.shape[1], k, tables, seed)
    steps = np.floor((np.rint(unit * _X_STEP) @ a + b) / (WIDTH * _A_STEP * _X_STEP)).astype(np.int64)
    mixed = np.zeros((len(unit), tables), np.uint64)
    for j in range(k):
        mixed = (mixed ^ steps[:, j::k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def normalised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows have a direction (no NaN, no infinity, not all 0). Scaled by powers of 2 first, so no square overflows."""
    most = np.abs(values).max(axis=1, initial=0)
    good = np.isfinite(most) & (most > 0)
    scaled = np.where(good[:, None], values, 1.0)
    scaled = np.ldexp(scaled, -np.frexp(np.where(good, most, 1.0))[1][:, None])
    return scaled / np.sqrt((scaled**2).sum(axis=1))[:, None], good


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """True where two unit vectors have this cosine at least. Pairs within rounding of it are summed exactly."""
    c = x @ y.T
    out = c >= cosine
    for i, j in np.argwhere(np.abs(c - cosine) < 1e-12):
        dot, xx, yy = (math.fsum(u * v for u, v in zip(p.tolist(), q.tolist())) for p, q in ((x[i], y[j]), (x[i], x[i]), (y[j], y[j])))
        out[i, j] = dot / math.sqrt(xx * yy) >= cosine - 1e-15
    return out


# -- work on a bucket ----------------------------------------------------------------------------------------------
def _first_meeting(mine: np.ndarray, theirs: np.ndarray, table: int) -> np.ndarray:
    """True for pairs (rows of ``mine`` and ``theirs``) that agree in no table before this one."""
    return ~(mine[:, :table] == theirs[:, :table]).any(axis=1)


def in_bucket(x: np.ndarray, weight: np.ndarray, block: np.ndarray | None, table: int, cosine: float, family: tuple[int, int, int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """What a bucket, or a pair of its blocks, adds: per node the rows linked to it here for the first time; and edges that span the links.

    ``block`` is True for nodes of the second block, and None for a whole bucket or a block with itself.
    """
    n = len(x)
    found = np.zeros(n, np.int64)
    if block is None:
        rows, columns = np.arange(n), np.arange(n)
    else:
        rows, columns = np.flatnonzero(~block), np.flatnonzero(block)
    near = linked(x[rows], x[columns], cosine)
    if block is None:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    if not len(i):
        return found, []
    i, j = rows[i], columns[j]
    fresh = np.ones(len(i), bool)
    if table:
        some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        known = codes(x[some], *family)[:, :table]
        place = place.reshape(2, -1)
        for start in range(0, len(i), 1 << 18):
            part = slice(start, start + (1 << 18))
            fresh[part] = _first_meeting(known[place[0, part]], known[place[1, part]], table)
    found += np.bincount(i[fresh], weight[j[fresh]], n).astype(np.int64)
    if block is not None:
        found += np.bincount(j[fresh], weight[i[fresh]], n).astype(np.int64)
    # the least member of each connected part: least neighbours, with jumps
    sides = [(i, j)]
    if block is not None:
        order = np.argsort(j, kind="stable")
        sides.append((j[order], i[order]))
    sides = [(mine, theirs, np.flatnonzero(np.diff(mine, prepend=-1))) for mine, theirs in sides]
    least = np.arange(n)
    while True:
        now = least.copy()
        for mine, theirs, starts in sides:
            now[mine[starts]] = np.minimum(now[mine[starts]], np.minimum.reduceat(least[theirs], starts))
        now = np.minimum(now, now[now])
        if (now == least).all():
            break
        least = now
    return found, [(int(a), int(b)) for a, b in enumerate(least) if a != b]


# -- Spark ---------------------------------------------------------------------------------------------------------
def _with_nodes(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Per row: ``row`` (all its columns), ``key``, ``node`` (a digest of the vector) and ``packed`` (its numbers as bytes), both null without a direction."""
    kind = _kind(vectors, vec)
    plain = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), F.col(f"`{key}`").alias("key"))
    numbers = F.col(f"`{vec}`").cast("array<float>" if kind is np.float32 else "array<double>")
    schema = StructType([*plain.schema.fields, StructField("node", BinaryType()), StructField("packed", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, packed = [], []
            for x in batch.column("numbers"):
                raw, found = x.values, None
                if raw is not None and len(raw) and not raw.null_count:
                    v = raw.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
                    found = v.tobytes() if np.isfinite(v).all() and v.any() else None
                packed.append(found)
                nodes.append(None if found is None else xxhash.xxh3_128_digest(found))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], names=["row", "key", "node", "packed"])

    return vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), F.col(f"`{key}`").alias("key"), numbers.alias("numbers")).mapInArrow(run, schema)


def _kind(vectors: DataFrame, vec: str) -> type:
    return np.float32 if vectors.schema[vec].dataType.elementType.simpleString() == "float" else np.float64


def _sent(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= MAX_SENT else small


def bucket_links(nodes: DataFrame, kind: type, k: int, tables: int, cosine: float, seed: int) -> DataFrame:
    """What the buckets add up to: rows (``node``, ``found``, null) and edges (``node``, null, ``other``).

    ``nodes``: ``node`` binary, ``n`` (rows that are equal), ``packed`` (its numbers).
    """
    family = (k, tables, seed)

    def coded(with_vectors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.array([len(x) for x in batch.column("packed").to_pylist()])
                for size in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == size))
                    values = np.frombuffer(b"".join(part.column("packed").to_pylist()), kind).reshape(part.num_rows, -1).astype(np.float64)
                    made = codes(normalised(values)[0], *family)
                    for t in range(tables):
                        columns = {"table": pa.array(np.full(part.num_rows, t, np.int32)), "dims": pa.array(np.full(part.num_rows, values.shape[1], np.int32)), "code": pa.array(made[:, t])}
                        columns |= {"node": part.column("node"), "n": part.column("n"), "packed": part.column("packed")} if with_vectors else {}
                        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    place = "table int, dims int, code bigint"
    sizes = nodes.select("packed").mapInArrow(coded(False), place).groupBy("table", "dims", "code").agg(F.count(F.lit(1)).alias("size"))
    hot = stage_table(sizes.filter(F.col("size") > BLOCK_ROWS).withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int")).drop("size"), "hot-buckets")
    rows = nodes.mapInArrow(coded(True), f"{place}, node binary, n bigint, packed binary")
    rows = rows.join(_sent(hot, hot.count()), ["table", "dims", "code"], "left").withColumn("mine", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    # a block meets itself and every other block of its bucket once
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("table", "dims", "code", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n", "packed")
    cell = ["table", "dims", "code", "i", "j"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("found", pa.int64()), ("other", pa.binary())])

        def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            group = pa.Table.from_batches(held)
            if group.num_rows < 2:
                return None
            table, i, j = (group.column(c)[0].as_py() for c in ("table", "i", "j"))
            x = np.frombuffer(b"".join(group.column("packed").to_pylist()), kind).reshape(group.num_rows, -1).astype(np.float64)
            block = None if i == j else group.column("mine").to_numpy() == j
            found, edges = in_bucket(normalised(x)[0], group.column("n").to_numpy(), block, table, cosine, family)
            node, some = group.column("node").to_pylist(), np.flatnonzero(found)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([node[a] for a in some] + [node[a] for a, _ in edges], pa.binary()),
                    pa.array([*found[some].tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array([*[None] * len(some), *[node[b] for _, b in edges]], pa.binary()),
                ],
                schema=schema,
            )

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted by cell: each is a stretch, maybe over several batches
            keys = np.stack([batch.column(c).to_numpy() for c in cell], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):
                key = keys[a].tolist() if b > a else last
                if held and key != last and (made := finish(held)) is not None:
                    yield made
                held = [*held, batch.slice(a, b - a)] if key == last else [batch.slice(a, b - a)]
                last = key
        if held and (made := finish(held)) is not None:
            yield made

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(meet, "node binary, found bigint, other binary")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = 0.9, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept`` for each row.

    ``n_links``: other rows linked directly, equal vectors included. ``component_id``: the least ``key`` reachable by
    links, the row's own included. ``kept``: ``key`` is the component's id. Linked are pairs found whose cosine in double
    precision is ``cosine`` (above 0) at least; none below it is. ``recall`` is the share found of pairs right at the
    threshold; of nearer pairs more are found.

    Vectors that are null, empty, zero, or have a null, NaN or infinite component link with nothing, nor do vectors of
    different lengths. Rows with a null ``key`` link like others but never name a component: theirs is the least id
    among the others, or null; they are kept if it is null. Rows that share a ``key`` stay separate rows. Other columns
    pass through; those of the new names are replaced. No rows: no rows.
    """
    vectors = vectors.drop("n_links", "component_id", "kept")
    rows = stage_table(_with_nodes(vectors, key, vec), "vectors")
    with_direction = rows.filter(F.col("node").isNotNull())
    nodes = with_direction.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.first("packed").alias("packed"))
    nodes = stage_table(nodes, "nodes")
    total = rows.count()
    k, tables = plan(nodes.count(), cosine, recall)
    links = stage_table(bucket_links(nodes.select("node", "n", "packed"), _kind(vectors, vec), k, tables, cosine, seed), "links")
    found = links.filter(F.col("found").isNotNull()).groupBy("node").agg(F.sum("found").alias("found"))
    parts = connected_components(links.filter(F.col("other").isNotNull()).select("node", "other"), "node", "other").withColumnRenamed("id", "node")
    about = nodes.select("node", "n", "low").join(found, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    lows = about.groupBy("part").agg(F.min("low").alias("component_id"))
    about = about.join(lows, "part").select("node", "n", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    about = stage_table(about, "about", tasks_for(total))
    # vectors with very many equal rows, 10000 at most, are sent; the rest is joined by few rows a key
    many = F.col("n") > max(1000, total // 10_000)
    sent, joined = F.broadcast(about.filter(many).drop("n")), about.filter(~many).drop("n")
    held = with_direction.select("row", "key", "node")
    out = [
        rows.filter(F.col("node").isNull()).select("row", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"), "key"),
        held.join(sent, "node").select("row", "n_links", "component_id", "key"),
        held.join(sent, "node", "left_anti").join(joined, "node").select("row", "n_links", "component_id", "key"),
    ]
    whole = out[0].unionByName(out[1]).unionByName(out[2])
    return whole.select("row.*", "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_neighbours(vectors: DataFrame) -> DataFrame:
    """The contract's query."""
    return near_vectors(vectors.select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


OP11_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS c FROM l GROUP BY x)
SELECT e.vec_id, coalesce(any_value(n.c), 0) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e JOIN r ON r.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id
"""
