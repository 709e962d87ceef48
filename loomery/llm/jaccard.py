"""N-gram Jaccard join by token-combination prefixes (operator 4).

Tokens (hashed word shingles) stand in one global order: rare ones first, then frequent ones by document frequency. A
set that may miss ``t`` of its tokens in a partner must share a signature with it: single tokens of its prefix if they
are rare, pairs or triples of them if they are frequent, the prefix being extended by what the combinations cost. So
common passages make no long lists of candidates, while no linked pair is missed:

- a class of tokens is dealt into groups by hash; combinations of ``k`` tokens are taken within a group. If ``n`` tokens
  of the prefix are in a group, partners that share none of its combinations differ in at least ``n - k + 1`` of them;
- the prefix ends where these numbers, summed over all groups, exceed ``t``. Partners then share a combination.

The number of groups depends on the size class of a set; near the border of a class it signs for both.

What decides nothing about results, only about work: which tokens count as frequent, and the bitmaps that tell tokens
of one document only (their signatures are left out, nobody can share them). Both come from exact counts over all
documents; they are broadcast within stated bounds, and beyond these left out.

Lists that share their least member are one list, named by it: near copies share hundreds of signatures, and so meet
once and not hundreds of times. Links are found for components, not for all pairs:

- sets that are equal are one node;
- each member of a list is verified against its least and its greatest member, and a list with very many members in
  other components against further members, as long as that still connects a good part of them;
- what is still apart is compared by parity sketches, whose differing bits are a lower bound of differing tokens. In a
  list the members of its largest component need not meet each other, only the others, the *strays*: short lists are
  joined, long ones are dealt into blocks of strays and of the rest that meet inside tasks. They first give back the
  nearest pairs that connect what they have; these are verified; then all pairs of different components that sketches
  can't rule out. A list of ``c`` near copies costs about ``c`` rows.

Every pair that shares a signature ends up verified, ruled out, or in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import SLICE_BYTES, arrow_slices
from loomery.llm.shingles import mix64, shingle_sets
from loomery.operators.components import connected_components
from loomery.session import drop_staged, stage_table, tasks_for

#: Tokens in this many documents or more come late in the order, by their frequency.
FREQUENT = 8
#: Tokens in this many documents or more are signed in pairs; 16 times as many: in triples.
PAIRED = 64
#: Parity sketches, by which pairs are ruled out before their sets are compared: bits for each token, and at least.
BITS_PER_TOKEN, LEAST_BITS = 4, 1024
#: Lists of more members are compared in blocks of so many members or bytes of sketches, inside tasks.
SMALL_LIST, BLOCK, BLOCK_BYTES = 16, 1000, 8 << 20
#: Pairs of sets that a task verifies.
SET_PAIRS = 10_000
#: Tokens of a slice of the token space, counted in one task.
SLICE_TOKENS = 1_000_000
#: Bounds of what is sent to every executor.
MAX_FREQUENT_TOKENS = 2_000_000
MAX_BITMAP_BYTES = 64 << 20
MAX_IDS = 2_000_000


def required(n, percent: int):
    """The least overlap of a set of ``n`` with a partner: ``percent`` % of it, rounded up."""
    return -(-n * percent // 100)


# -- passes over the texts -----------------------------------------------------------------------------------------
def _over_sets(docs: DataFrame, k: int, schema: str, made: Callable[[pa.RecordBatch, list[np.ndarray]], dict | None], size: int = SLICE_BYTES) -> DataFrame:
    """The columns ``schema`` that ``made`` gives for a slice of rows and their sets at a time."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_slices(batches, "text", size):
            found = made(rows, list(shingle_sets(rows.column("text").cast(pa.binary()).to_pylist(), k)))
            if found is not None:
                yield pa.RecordBatch.from_arrays([found[x] for x in names], names=names)

    return docs.mapInArrow(run, schema)


def set_table(docs: DataFrame, k: int, key: str) -> DataFrame:
    """Per row: ``key``, ``n_shingles`` and ``fp``, a 128-bit digest of its set (null for an empty set)."""

    def made(rows: pa.RecordBatch, sets: list[np.ndarray]) -> dict:
        fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return {key: rows.column(key), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array(fp, pa.binary())}

    return _over_sets(docs.select(key, "text"), k, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_shingles bigint, fp binary", made)


def token_counts(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Document frequencies by slice (the token's first ``bits`` bits): a bitmap of repeated tokens, and frequent ones.

    Tokens travel as packed 32-bit numbers, counted per slice of texts; a token in many documents is a few numbers each.
    Columns: ``slice``, ``repeated`` (bitmap), ``tokens`` and ``counts`` (packed, of frequent tokens).
    """
    shift = np.uint64(32 - bits)

    def split(rows: pa.RecordBatch, sets: list[np.ndarray]) -> dict | None:
        sets = [s for s in sets if len(s)]
        if not sets:
            return None
        short, n = np.unique(np.concatenate(sets) >> shift, return_counts=True)
        high = (short >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        low, many = (short & np.uint64(0xFFFFFFFF)).astype(np.uint32), n > 1
        out = {"slice": high[starts].astype(np.int32), "once": [], "more": [], "n": []}
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(low)]):
            part, again = low[a:b], many[a:b]
            out["once"].append(part[~again].tobytes())
            out["more"].append(part[again].tobytes())
            out["n"].append(n[a:b][again].astype(np.uint32).tobytes())
        return {x: pa.array(v, pa.int32() if x == "slice" else pa.binary()) for x, v in out.items()}

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(rows["once"]), np.uint32)
        more = np.frombuffer(b"".join(rows["more"]), np.uint32)
        n = np.frombuffer(b"".join(rows["n"]), np.uint32)
        tokens, single = np.unique(once, return_counts=True)
        # one sort for both kinds
        both, place = np.unique(np.concatenate([tokens, more]), return_inverse=True)
        total = np.bincount(place, np.concatenate([single, n])).astype(np.int64) if len(both) else np.zeros(0, np.int64)
        again = both[total > 1]
        size = 1 << max(10, int(len(again) * 8 - 1).bit_length()) if len(again) else 1 << 10
        marks = np.zeros(size, bool)
        marks[again & np.uint32(size - 1)] = True
        often = total >= FREQUENT
        return pd.DataFrame(
            {"slice": [key[0]], "repeated": [np.packbits(marks).tobytes()], "tokens": [both[often].tobytes()], "counts": [np.minimum(total[often], 0xFFFFFFFF).astype(np.uint32).tobytes()]}
        )

    # larger slices of texts than elsewhere: the more texts, the fewer rows
    parts = _over_sets(docs.select("text"), k, "slice int, once binary, more binary, n binary", split, 4 * SLICE_BYTES)
    return parts.groupBy("slice").applyInPandas(count, "slice int, repeated binary, tokens binary, counts binary")


class TokenOrder:
    """The global order and the repeated tokens, as far as they fit their bounds; the same on every executor."""

    def __init__(self, bits: int, bitmaps: dict[int, bytes] | None, tokens: np.ndarray, counts: np.ndarray, frequent: int):
        self.shift = np.uint64(32 - bits)
        self.bitmaps = bitmaps
        self.tokens, self.counts, self.frequent = tokens, counts, frequent

    @staticmethod
    def collect(slices: DataFrame, bits: int) -> TokenOrder:
        sizes = slices.agg(F.sum(F.octet_length("repeated")).alias("b"), F.sum(F.octet_length("tokens") / 4).alias("t")).first()
        bitmaps = {r["slice"]: bytes(r["repeated"]) for r in slices.select("slice", "repeated").collect()} if (sizes["b"] or 0) <= MAX_BITMAP_BYTES else None
        limit = FREQUENT

        def above(key_counts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in key_counts:
                for s, t, c in zip(batch["slice"], batch["tokens"], batch["counts"]):
                    c, t = np.frombuffer(c, np.uint32), np.frombuffer(t, np.uint32)
                    yield pd.DataFrame({"slice": [s], "tokens": [t[c >= limit].tobytes()], "counts": [c[c >= limit].tobytes()]})

        chosen = slices.select("slice", "tokens", "counts")
        while (sizes["t"] or 0) > MAX_FREQUENT_TOKENS:  # a higher limit, until they fit
            limit *= 2
            chosen = slices.select("slice", "tokens", "counts").mapInPandas(above, "slice int, tokens binary, counts binary")
            sizes = chosen.agg(F.sum(F.octet_length("tokens") / 4).alias("t")).first()
        rows = sorted((r["slice"], bytes(r["tokens"]), bytes(r["counts"])) for r in chosen.collect())
        none = [np.zeros(0, np.uint64)]
        tokens = np.concatenate([(np.uint64(s) << np.uint64(32)) | np.frombuffer(t, np.uint32).astype(np.uint64) for s, t, _ in rows] or none)
        counts = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in rows] or none)
        return TokenOrder(bits, bitmaps, tokens, counts, limit)

    def frequencies(self, tokens: np.ndarray) -> np.ndarray:
        """Document frequency of frequent tokens, 0 for the others."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        short = tokens >> self.shift
        at = np.minimum(np.searchsorted(self.tokens, short), len(self.tokens) - 1)
        return np.where(self.tokens[at] == short, self.counts[at], 0).astype(np.int64)

    def maybe_repeated(self, tokens: np.ndarray) -> np.ndarray:
        """False only for tokens of a single document."""
        if self.bitmaps is None:
            return np.ones(len(tokens), bool)
        short = tokens >> self.shift
        slices, low = (short >> np.uint64(32)).astype(np.int64), (short & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = np.zeros(len(tokens), bool)
        for s in np.unique(slices):
            raw = np.frombuffer(self.bitmaps.get(int(s), b"\0"), np.uint8)
            mine = slices == s
            bit = low[mine] & (len(raw) * 8 - 1)
            out[mine] = (raw[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
        return out


def _size_class(n: int) -> int:
    return n.bit_length() - 1


def signatures(tokens: np.ndarray, order: TokenOrder, percent: int) -> np.ndarray:
    """The signatures of one set: 64-bit hashes, sorted and distinct."""
    n = len(tokens)
    misses = n - required(n, percent)
    df = order.frequencies(tokens)
    rank = np.lexsort((tokens, df))
    tokens, df = tokens[rank], df[rank]
    kinds = np.where(df < max(PAIRED, order.frequent), 1, np.where(df < 16 * max(PAIRED, order.frequent), 2, 3))
    classes = {_size_class(n), _size_class(max(1, required(n, percent))), _size_class(n * 100 // percent)}
    out = []
    for cls in sorted(classes):
        salt = np.uint64(cls * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        k = kinds if cls >= 6 else np.ones(n, np.int64)  # small sets are signed by single tokens
        n_groups = np.maximum(1, (0.08 * 2**cls / np.maximum(1, k - 1)).astype(np.int64))
        group = np.where(k == 1, -1, (mix64(tokens ^ salt) % n_groups.astype(np.uint64)).astype(np.int64) * 4 + k)
        # a token counts from the k-th of its group on
        counted = np.ones(n, np.int64)
        for kind in (2, 3):
            mine = np.flatnonzero(k == kind)
            if len(mine):
                by = mine[np.argsort(group[mine], kind="stable")]
                g = group[by]
                first = np.flatnonzero(np.diff(g, prepend=-2) != 0)
                within = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
                counted[by] = within >= kind - 1
        end = int(np.searchsorted(np.cumsum(counted), misses + 1)) + 1
        head, head_kinds, head_group = tokens[:end], k[:end], group[:end]
        single = head[head_kinds == 1]
        out.append(mix64(single[order.maybe_repeated(single)] ^ salt))
        for g in np.unique(head_group[head_kinds > 1]):
            members, kind = np.sort(head[head_group == g]), int(g % 4)
            if len(members) >= kind:
                chosen = np.array(list(combinations(range(len(members)), kind)))
                made = np.full(len(chosen), salt + np.uint64(kind))
                for column in chosen.T:
                    made = mix64(made ^ members[column])
                out.append(made)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def signature_table(docs: DataFrame, k: int, percent: int, order, key: str) -> DataFrame:
    """Rows ``sig``, ``key``, ``n`` of all sets; ``order`` is a broadcast :class:`TokenOrder`."""

    def made(rows: pa.RecordBatch, sets: list[np.ndarray]) -> dict | None:
        known = order.value
        found = [signatures(s, known, percent) if len(s) else s for s in sets]
        each = [len(x) for x in found]
        if not sum(each):
            return None
        sizes = np.repeat(np.array([len(s) for s in sets], np.int64), each)
        place = pa.array(np.repeat(np.arange(len(sets)), each))
        return {"sig": pa.array(np.concatenate(found).view(np.int64)), key: rows.column(key).take(place), "n": pa.array(sizes)}

    return _over_sets(docs.select(key, "text"), k, f"sig bigint, `{key}` bigint, n bigint", made)


def _those(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The documents that are (or are not) in ``ids``, one column ``key``: by a broadcast up to ``MAX_IDS`` of them."""
    return docs.select(key, "text").join(F.broadcast(ids) if ids.count() <= MAX_IDS else ids, key, how)


def token_table(docs: DataFrame, k: int, ids: DataFrame, key: str) -> DataFrame:
    """The packed sets of the documents in ``ids``."""

    def made(rows: pa.RecordBatch, sets: list[np.ndarray]) -> dict:
        return {key: rows.column(key), "tokens": pa.array([s.tobytes() for s in sets], pa.binary())}

    return _over_sets(_those(docs, ids, key), k, f"`{key}` bigint, tokens binary", made)


def sketch_table(docs: DataFrame, k: int, ids: DataFrame, key: str) -> DataFrame:
    """Sizes and parity sketches of the documents in ``ids``: bit ``i`` tells whether an odd number of tokens fall on it."""

    def made(rows: pa.RecordBatch, sets: list[np.ndarray]) -> dict:
        bits = []
        for s in sets:
            size = max(LEAST_BITS, 1 << (BITS_PER_TOKEN * len(s) - 1).bit_length())
            odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
            bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return {key: rows.column(key), "n": pa.array([len(s) for s in sets], pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64()))}

    return _over_sets(_those(docs, ids, key), k, f"`{key}` bigint, n bigint, bits array<bigint>", made)


# -- pairs -----------------------------------------------------------------------------------------------------------
def _fitting(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _folded(bits, to):
    """A sketch of twice the size of another, folded to its size; else itself."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) == 2 * F.size(to), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int, key: str, tasks: int) -> DataFrame:
    """Pairs whose sketches don't rule them out: sets differ at least in as many tokens as their sketches in bits."""
    left, right = (sketches.select(F.col(key).alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").coalesce(tasks).join(right, "b").coalesce(tasks)
    both = both.withColumns({"_a": _folded(F.col("bits_a"), F.col("bits_b")), "_b": _folded(F.col("bits_b"), F.col("bits_a"))}).filter(F.size("_a") == F.size("_b"))
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b")


def _by_width(bits: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sketches of each width as a matrix, with their places."""
    size = np.array([len(x) for x in bits])
    places = {int(w): np.flatnonzero(size == w) for w in np.unique(size)}
    return {w: (np.stack([bits[i] for i in at]), at) for w, at in places.items()}


def _near_pairs(strays: pd.DataFrame, others: pd.DataFrame, key: str, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a stray and another of a different component that their sketches don't rule out.

    With ``forest`` the nearest ones only, until all they connect is one: each pair taken joins its two components at
    once, so no more pairs come out than there are components. One stray's distances are held at a time.
    """
    names, where = np.unique(np.concatenate([strays["component"].to_numpy(), others["component"].to_numpy()]), return_inverse=True)
    mine, theirs = where[: len(strays)].copy(), where[len(strays) :].copy()
    n_a, n_b = strays["n"].to_numpy(), others["n"].to_numpy()
    left, right = (_by_width([np.asarray(x, np.int64).view(np.uint64) for x in rows["bits"]]) for rows in (strays, others))
    a, b = [], []
    for w, (rows, at_a) in left.items():
        for v, (found, at_b) in right.items():
            if v not in (w, 2 * w) and w != 2 * v:
                continue  # sizes too far apart for any link
            half = min(w, v)
            near_a = rows if w == half else rows[:, :half] ^ rows[:, half:]
            near_b = found if v == half else found[:, :half] ^ found[:, half:]
            for i, bits in zip(at_a, near_a):
                apart = theirs[at_b] != mine[i]
                if not apart.any():
                    continue
                differ = np.bitwise_count(near_b ^ bits).sum(axis=1, dtype=np.int64)
                ok = apart & (differ * (100 + percent) <= (n_a[i] + n_b[at_b]) * (100 - percent))
                if not forest:
                    a.append(np.full(int(ok.sum()), i))
                    b.append(at_b[ok])
                    continue
                while ok.any():
                    j = at_b[np.flatnonzero(ok)[differ[ok].argmin()]]
                    a.append([i])
                    b.append([j])
                    gone = theirs[j]
                    mine[mine == gone] = mine[i]
                    theirs[theirs == gone] = mine[i]
                    ok &= theirs[at_b] != mine[i]
    none = [np.zeros(0, np.int64)]
    x, y = strays[key].to_numpy()[np.concatenate(a or none)], others[key].to_numpy()[np.concatenate(b or none)]
    return np.minimum(x, y), np.maximum(x, y)


def _strays(members: DataFrame) -> DataFrame:
    """Add ``stray``: whether a member is outside of the largest component of its list (of equals, the last)."""
    sizes = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("hub").agg(F.max(F.struct("c", "component"))["component"].alias("_largest"))
    return members.join(largest, "hub").withColumn("stray", F.col("component") != F.col("_largest")).drop("_largest")


def pairs_in_blocks(members: DataFrame, sketches: DataFrame, percent: int, key: str, forest: bool) -> DataFrame:
    """Pairs ``a``, ``b`` of long lists (``hub``, ``key``, ``component``, ``stray``), by sketch.

    The strays and the others of a list are dealt into blocks; a task holds a block of strays and one other block. So a
    member that is no stray goes to as many tasks as there are blocks of strays, most often one.
    """
    known = members.join(sketches.drop("n"), key)
    per = known.groupBy("hub", "stray").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("bits").cast("long") * 8) / BLOCK_BYTES)).alias("blocks")
    )
    per = per.groupBy("hub").agg(F.max(F.when(F.col("stray"), F.col("blocks"))).alias("_s"), F.max(F.when(~F.col("stray"), F.col("blocks"))).alias("_o"))
    dealt = known.join(per, "hub").withColumn("_i", F.pmod(F.xxhash64(key), F.when(F.col("stray"), F.col("_s")).otherwise(F.col("_o"))).cast("int"))
    cell = lambda kind, lo, hi, part: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), F.lit(part).alias("part"))
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    i = F.col("_i")
    with_others = F.transform(upto(F.col("_o")), lambda j: cell(1, i, j, 0))
    with_strays = F.transform(upto(F.col("_s")), lambda j: cell(0, F.least(i, j), F.greatest(i, j), 0))
    cells = F.when(F.col("stray"), F.concat(with_others, with_strays)).otherwise(F.transform(upto(F.col("_s")), lambda j: cell(1, j, i, 1)))
    met = dealt.withColumn("_cell", F.explode(cells)).select("hub", "_cell.kind", "_cell.lo", "_cell.hi", "_cell.part", "_i", key, "n", "component", "bits")

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, kind, lo, hi = group
        if kind:
            first, second = rows[rows["part"] == 0], rows[rows["part"] == 1]
        else:
            first, second = rows[rows["_i"] == lo], rows[rows["_i"] == hi]
        a, b = _near_pairs(first, second, key, percent, forest)
        return pd.DataFrame({"a": a, "b": b})

    return met.groupBy("hub", "kind", "lo", "hi").applyInPandas(run, "a long, b long").filter("a < b").distinct()


def _pairs_in_short_lists(members: DataFrame, percent: int, key: str) -> DataFrame:
    """Pairs of a stray and a member of another component, of sizes that fit, in lists of ``SMALL_LIST`` members at most."""
    one = members.filter("stray").select("hub", F.col(key).alias("x"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    other = members.select("hub", F.col(key).alias("y"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    return one.join(other, "hub").filter("c_a <> c_b").filter(_fitting(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, key: str, n_pairs: int) -> DataFrame:
    """Of the ``n_pairs`` pairs ``a``, ``b`` those with ``100 * intersection >= percent * union``, by their whole sets; staged."""
    ids = stage_table(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "ids", tasks_for(2 * n_pairs))
    sets = stage_table(token_table(docs, k, ids, key), "tokens")
    left, right = (sets.select(F.col(key).alias(x), F.col("tokens").alias(f"t_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("t_a"), batch.column("t_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    n_tasks = tasks_for(n_pairs, SET_PAIRS)
    met = pairs.select("a", "b").join(left, "a").coalesce(n_tasks).join(right, "b").coalesce(n_tasks)
    out = stage_table(met.mapInArrow(run, "a long, b long"), "links")
    drop_staged(ids, sets)
    return out


def _star(members: DataFrame, choose, percent: int, key: str) -> DataFrame:
    """Pairs of each member of a list with one of the list, those already in one component left out."""
    lead = members.groupBy("hub").agg(choose.alias("lead"))
    pairs = members.join(lead, "hub").select(
        F.least(key, "lead." + key).alias("a"), F.greatest(key, "lead." + key).alias("b"),
        F.col("n").alias("n_a"), F.col("lead.n").alias("n_b"), F.col("component").alias("c_a"), F.col("lead.component").alias("c_b"),
    )
    return pairs.filter("c_a <> c_b").filter(_fitting(percent)).select("a", "b").distinct()


def _labelled(members: DataFrame, components: DataFrame, key: str, tasks: int) -> DataFrame:
    """Members with their present component, of lists that still hold more than one; staged."""
    named = members.drop("component").join(components.withColumnRenamed("id", key), key, "left").withColumn("component", F.coalesce("component", key)).coalesce(tasks)
    open_lists = named.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("hub").coalesce(tasks)
    return stage_table(named.join(open_lists, "hub"), "members", tasks)


def _many_strays(members: DataFrame) -> int:
    """How many strays the lists with more than a block of them hold."""
    many = _strays(members).filter("stray").groupBy("hub").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
    return many.agg(F.sum("c").alias("c")).first()["c"] or 0


def link_components(docs: DataFrame, percent: int = 85, k: int = 4, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` (``key`` long, ``text``): ``n_shingles`` and ``component_id``, the least key reachable by links.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles, words split at
    ASCII white space, A-Z lower-cased. Empty texts (nulls too) link with nothing. Rows with one key are one node; rows
    with a null key get their size and a null component. Repeated rows come out as often as they went in. Texts of any
    length are taken whole; other columns are left out; no rows: no rows. ``percent`` is above 50 and at most 100.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    docs = docs.select(key, "text")
    sizes = stage_table(set_table(docs, k, key), "sets")
    known = sizes.filter(F.col(key).isNotNull() & F.col("fp").isNotNull())
    classes = known.groupBy("fp").agg(F.min(key).alias("rep"))
    reps = classes.select(F.col("rep").alias(key)).distinct()

    total = known.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    bits = min(24, max(3, (total // SLICE_TOKENS).bit_length()))
    slices = stage_table(token_counts(docs, k, bits), "token-counts")
    order = docs.sparkSession.sparkContext.broadcast(TokenOrder.collect(slices, bits))
    copies = stage_table(known.select(key).distinct().join(reps, key, "left_anti"), "copies")
    own = _those(docs.filter(F.col(key).isNotNull()), copies, key, "left_anti")
    signed = stage_table(signature_table(own, k, percent, order, key), "signatures")
    order.destroy()
    lists = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("hub")).filter("c > 1").select("sig", "hub")
    members = stage_table(signed.join(lists, "sig").select("hub", key, "n", F.col(key).alias("component")).distinct(), "members")
    n_tasks = tasks_for(members.count())
    drop_staged(slices, copies, signed)

    ids = stage_table(members.select(key).distinct(), "ids", n_tasks)
    sketches = stage_table(sketch_table(docs, k, ids, key), "sketches")
    drop_staged(ids)
    # rows that share a key are one node, though their sets differ
    links = classes.join(known, "fp").filter(F.col("rep") != F.col(key)).select(F.col("rep").alias("a"), F.col(key).alias("b"))
    twice = stage_table(links.join(known.groupBy(key).agg(F.count_distinct("fp").alias("c")).filter("c > 1").withColumnRenamed(key, "b").select("b"), "b", "left_semi").select("a", "b"), "links")
    found, components = [twice], None

    def step(likely: DataFrame) -> DataFrame:
        """Verify pairs and give the components of all links so far."""
        likely = stage_table(likely, "pairs", n_tasks)
        n_pairs = likely.count()
        new = verified(likely, docs, k, percent, key, n_pairs) if n_pairs else None
        drop_staged(likely)
        if components is not None and (new is None or not new.limit(1).count()):
            return components
        found.append(new if new is not None else likely.sparkSession.createDataFrame([], "a long, b long"))
        edges = found[0]
        for x in found[1:]:
            edges = edges.unionByName(x)
        return stage_table(connected_components(edges, "a", "b"), "components", n_tasks)

    whom = F.struct(key, "n", "component")
    stars = _star(members, F.min(whom), percent, key).unionByName(_star(members, F.max(whom), percent, key)).coalesce(n_tasks).distinct()
    before, turn = None, 0
    while True:
        components = step(plausible(stars, sketches, percent, key, n_tasks))
        old, members = members, _labelled(members, components, key, n_tasks)
        drop_staged(old)
        left = _many_strays(members)
        if not left or (before is not None and left > 0.9 * before):
            break
        before, turn = left, turn + 1
        stars = _star(members, F.min_by(whom, F.xxhash64(F.lit(turn), key)), percent, key)
    for forest in (True, False):
        apart = stage_table(_strays(members), "apart", n_tasks)
        lengths = apart.groupBy("hub").agg(F.count(F.lit(1)).alias("c"))
        long = apart.join(lengths.filter(F.col("c") > SMALL_LIST).select("hub"), "hub").coalesce(n_tasks)
        likely = pairs_in_blocks(long, sketches, percent, key, forest)
        if not forest:
            short = apart.join(lengths.filter(F.col("c") <= SMALL_LIST).select("hub"), "hub").coalesce(n_tasks)
            likely = likely.unionByName(plausible(_pairs_in_short_lists(short, percent, key), sketches, percent, key, n_tasks)).distinct()
        last, components = components, step(likely)
        drop_staged(apart)
        if forest and components is not last:
            old, members = members, _labelled(members, components, key, n_tasks)
            drop_staged(old)
    drop_staged(members, sketches, *found)

    return (
        sizes.join(classes, "fp", "left")
        .withColumn("_node", F.coalesce("rep", F.col(key)))
        .join(components.withColumnRenamed("id", "_node"), "_node", "left")
        .select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component", "_node")).alias("component_id"))
    )


def op4_jaccard(docs: DataFrame) -> DataFrame:
    """The contract of operator 4 over ``documents``."""
    return link_components(docs, percent=85, k=4)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.m, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON s.doc_id = c.x
"""
