"""Reversible, incremental line dedup with sharded cuckoo filters (operator 8).

The state of a corpus is an exact table of reference counts: for each line key, how many documents hold it. Keys that
reach the limit are *common*; each shard of them also has a cuckoo filter, a compact set that allows insertions and
deletions. Adding documents adds to the counts and puts keys that reach the limit into their filters; deleting
documents subtracts, and takes keys that fall below it out again. So a line dropped because ten documents shared it
comes back when one of them goes.

To clean documents, their lines are asked of the filters inside the tasks that read the texts; what a filter knows is
a candidate and is confirmed against the exact common keys. Up to a stated number of these, they go along with the
filters and no text is shuffled. Beyond it the filters are sent in slices of shards, each of a stated size and asked in
a pass of its own; their candidates are confirmed in a join, and what each text loses is joined to it, to texts with very
many copies by sending it. The result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import SLICE_BYTES, SPACE_CHARS, arrow_slices
from loomery.session import drop_staged, stage_table

STRIP = SPACE_CHARS.encode()
SLOTS = 4
MAX_KICKS = 500


class CuckooFilter:
    """A set of 64-bit hashes as 16-bit fingerprints in buckets of four. Never forgets a member; deletes exactly.

    ``delete`` must be given members only. An insertion that finds no place doubles the table from ``rebuild``.
    """

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets  # a power of two
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def sized(n_keys: int) -> CuckooFilter:
        need = max(1, int(n_keys / (SLOTS * 0.8)) + 1)
        return CuckooFilter(1 << (need - 1).bit_length())

    @staticmethod
    def _fingerprints(h: np.ndarray) -> np.ndarray:
        f = (h >> np.uint64(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = self._fingerprints(h)
        mask = np.uint64(self.n - 1)
        one = h & mask
        return f, one.astype(np.int64), ((one ^ self._turn(f)) & mask).astype(np.int64)

    @staticmethod
    def _turn(f: np.ndarray) -> np.ndarray:
        return (f.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """For each hash whether it may be a member: always for members, for others about once in 8000."""
        f, one, two = self._places(h)
        return (self.table[one] == f[:, None]).any(axis=1) | (self.table[two] == f[:, None]).any(axis=1)

    def insert(self, h: np.ndarray) -> bool:
        """Insert distinct hashes; false if one found no place (the filter must then be rebuilt larger)."""
        table, mask = self.table, self.n - 1
        for f, one, two in zip(*(x.tolist() for x in self._places(h))):
            at = one
            for kick in range(MAX_KICKS):
                for bucket in ((one, two) if kick == 0 else (at,)):
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = f
                        break
                else:
                    k = (f + kick) % SLOTS
                    f, table[at, k] = int(table[at, k]), f
                    at = (at ^ ((f * 0x5BD1E995) >> 3)) & mask
                    continue
                break
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Remove members."""
        for f, one, two in zip(*(x.tolist() for x in self._places(h))):
            for bucket in (one, two):
                found = np.flatnonzero(self.table[bucket] == f)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> CuckooFilter:
        table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return CuckooFilter(len(table), table)

    @staticmethod
    def of(h: np.ndarray) -> CuckooFilter:
        """A filter that holds the distinct hashes."""
        made = CuckooFilter.sized(len(h))
        while not made.insert(h):
            made = CuckooFilter(made.n * 2)
        return made


def line_key(line: bytes) -> bytes:
    """A line with white space stripped at both ends and A-Z lower-cased."""
    return line.strip(STRIP).lower()


def _keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[int | None]]:
    """Lines of a text, and for each its key as a 128-bit number (None if the key is too short to count)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    hashed = []
    for line in lines:
        key = line_key(line)
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        hashed.append(None if short else xxhash.xxh3_128_intdigest(key))
    return lines, hashed


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_LOW = (1 << 64) - 1


def reference_counts(docs: DataFrame, min_chars: int = 1, sign: int = 1, key: str | None = None) -> DataFrame:
    """Counts of documents by line key: ``hi``, ``lo`` (the key's 128-bit hash) and ``n_docs``, times ``sign``.

    Each row of ``docs`` (``text``) is a document; a key counts once in it. With ``key``, rows that share one are a
    document together, and rows where it is null are each one. Nulls count as empty texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_slices(batches, "text", 4 * SLICE_BYTES):
            seen: dict[int, int] = {}
            for text in rows.column("text").to_pylist():
                for k in {k for k in _keys(text, min_chars)[1] if k is not None}:
                    seen[k] = seen.get(k, 0) + 1
            hi = np.fromiter((_signed(k >> 64) for k in seen), np.int64, len(seen))
            lo = np.fromiter((_signed(k & _LOW) for k in seen), np.int64, len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=["hi", "lo", "n"])

    def counted(rows: DataFrame) -> DataFrame:
        part = rows.select("text").mapInArrow(run, "hi bigint, lo bigint, n bigint")
        return part.groupBy("hi", "lo").agg((F.sum("n") * sign).alias("n_docs"))

    if key is None:
        return counted(docs)
    # rows that share a key are few: they are counted apart, and what they count twice is taken off
    again = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(key)
    again = stage_table(again, "repeated-keys")
    if not again.limit(1).count():
        return counted(docs)
    tagged = docs.join(again, key, "left_semi").select(F.lit(False).alias("_none"), F.xxhash64(key).alias("_id"), F.xxhash64(key, F.lit(1)).alias("_text"), "text")
    twice = candidates(tagged, LineIndex(None, None, 0, min_chars, 1)).groupBy("hi", "lo", "_id", "_text").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    over = twice.groupBy("hi", "lo").agg((F.sum(F.col("_c") - 1) * -sign).alias("n_docs"))
    return counted(docs).unionByName(over).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"))


@dataclass
class LineIndex:
    """The state: exact counts (``hi``, ``lo``, ``n_docs``), and a filter of the common keys per shard."""

    counts: DataFrame
    filters: DataFrame  # shard int, n_keys long, bits binary
    min_docs: int
    min_chars: int
    n_shards: int

    def common(self) -> DataFrame:
        """The exact keys that reach the limit."""
        return self.counts.filter(F.col("n_docs") >= self.min_docs).select("hi", "lo")


def _shard(n_shards: int):
    return F.pmod("hi", F.lit(n_shards)).cast("int")


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """One cuckoo filter per shard of ``keys`` (distinct ``hi``, ``lo``)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(np.sort(rows["lo"].to_numpy().view(np.uint64)))
        return pd.DataFrame({"shard": [key[0]], "n_keys": [len(rows)], "bits": [made.to_bytes()]})

    return keys.select("lo", _shard(n_shards).alias("shard")).groupBy("shard").applyInPandas(run, "shard int, n_keys long, bits binary")


def build(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keys_per_shard: int = 100_000, key: str | None = None) -> LineIndex:
    """The index of ``docs``, of rows or, with ``key``, of documents by it. Shards grow in number with the common keys, not in size."""
    counts = stage_table(reference_counts(docs, min_chars, key=key), "line-counts")
    return _indexed(counts, min_docs, min_chars, keys_per_shard)


def _indexed(counts: DataFrame, min_docs: int, min_chars: int, keys_per_shard: int) -> LineIndex:
    common = counts.filter(F.col("n_docs") >= min_docs)
    n_shards = max(1, -(-common.count() // keys_per_shard))
    return LineIndex(counts, stage_table(build_filters(common, n_shards), "line-filters"), min_docs, min_chars, n_shards)


def update(index: LineIndex, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> LineIndex:
    """The index after inserting and deleting documents. Only filters of keys that cross the limit change.

    ``deleted`` must hold documents that are in the index. Keys whose count falls to 0 leave the table.
    """
    changes = [reference_counts(x, index.min_chars, s) for x, s in ((inserted, 1), (deleted, -1)) if x is not None]
    if not changes:
        return index
    delta = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    delta = delta.groupBy("hi", "lo").agg(F.sum("n_docs").alias("change"))
    joined = stage_table(
        index.counts.join(delta, ["hi", "lo"], "full_outer").select(
            "hi", "lo", F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n_docs")
        ),
        "line-counts",
    )
    crossing = joined.select(
        "lo",
        _shard(index.n_shards).alias("shard"),
        F.when((F.col("before") < index.min_docs) & (F.col("n_docs") >= index.min_docs), 1)
        .when((F.col("before") >= index.min_docs) & (F.col("n_docs") < index.min_docs), -1)
        .alias("turn"),
    ).filter("turn IS NOT NULL")

    def run(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.from_bytes(old["bits"].iloc[0]) if len(old) else CuckooFilter.sized(len(rows))
        lo, turn = rows["lo"].to_numpy().view(np.uint64), rows["turn"].to_numpy()
        held.delete(lo[turn < 0])
        n = (int(old["n_keys"].iloc[0]) if len(old) else 0) + int(turn.sum())
        fits = n <= held.n * SLOTS * 0.9 and held.insert(lo[turn > 0])
        # a filter that is full is built anew, larger, from the exact table (below)
        return pd.DataFrame({"shard": [key[0]], "n_keys": [n], "bits": [held.to_bytes() if fits else b""]})

    filters = stage_table(
        index.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(run, "shard int, n_keys long, bits binary"), "line-filters"
    )
    counts = joined.filter("n_docs > 0").select("hi", "lo", "n_docs")
    if filters.filter(F.octet_length("bits") == 0).limit(1).count():
        common = counts.filter(F.col("n_docs") >= index.min_docs)
        filters = stage_table(build_filters(common, index.n_shards), "line-filters")
    return LineIndex(counts, filters, index.min_docs, index.min_chars, index.n_shards)


#: Exact common keys that are sent along with the filters (about 40 bytes each); more are confirmed in a join.
MAX_KEYS = 1_000_000
#: Bytes of filters that are sent at once.
FILTER_BYTES = 64 << 20
_NO_KEY = -(1 << 63)


def _tagged(docs: DataFrame, key: str | None) -> DataFrame:
    """Add what tells texts apart for their first holder: ``_none``, ``_id`` (a number that grows with the key) and ``_text``."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumns({"_none": (F.col(key).isNull() if key else F.lit(False)), "_id": F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)) if key else F.lit(_NO_KEY), "_text": digest})


def _filters(index: LineIndex) -> dict[int, bytes]:
    return {r["shard"]: r["bits"] for r in index.filters.collect()}


def candidates(docs: DataFrame, index: LineIndex, filters=None) -> DataFrame:
    """Distinct ``hi``, ``lo`` of the lines that the filters know (all lines without filters), with the tag of their text.

    ``filters`` is a broadcast dictionary of filters by shard.
    """
    min_chars, n_shards = index.min_chars, index.n_shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if filters is None else {k: CuckooFilter.from_bytes(v) for k, v in filters.value.items()}
        for rows in arrow_slices(batches, "text"):
            at, hi, lo = _hashed(rows.column("text").to_pylist(), min_chars)
            if known is not None:
                maybe = _known(known, n_shards, hi, lo)
                at, hi, lo = at[maybe], hi[maybe], lo[maybe]
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(place) for c in ("_none", "_id", "_text")), pa.array(hi), pa.array(lo)], names=["_none", "_id", "_text", "hi", "lo"])

    return docs.select("_none", "_id", "_text", "text").mapInArrow(run, "_none boolean, _id bigint, _text bigint, hi bigint, lo bigint")


def confirmed(tagged: DataFrame, index: LineIndex, common: DataFrame) -> DataFrame:
    """Candidates of all filters, sent a slice of shards at a time, that are exact common keys: columns of ``candidates`` and of ``common``."""
    slices, held = [[]], 0
    for r in index.filters.select("shard", F.octet_length("bits").alias("b")).orderBy("shard").collect():  # a row a shard
        if held and held + r["b"] > FILTER_BYTES:
            slices.append([])
            held = 0
        slices[-1].append(r["shard"])
        held += r["b"]
    found = []
    for shards in slices:
        sent = tagged.sparkSession.sparkContext.broadcast({r["shard"]: r["bits"] for r in index.filters.filter(F.col("shard").isin(shards)).collect()})
        found.append(stage_table(candidates(tagged, index, sent), "line-candidates"))
        sent.destroy()
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    out = stage_table(whole.join(common, ["hi", "lo"]), "line-confirmed")
    drop_staged(*found)
    return out


def _with_lost(tagged: DataFrame, gone: DataFrame) -> DataFrame:
    """``tagged`` with ``_common``, joined by the tag of a text. What texts with very many rows lose is sent: there are 10000 of these at most."""
    tag = ["_none", "_id", "_text"]
    sizes = stage_table(tagged.groupBy(*tag).agg(F.count(F.lit(1)).alias("_c")), "text-copies")
    limit = max(1000, (sizes.agg(F.sum("_c")).first()[0] or 0) // 10_000)
    hot = F.broadcast(sizes.filter(F.col("_c") > limit).select(*tag))
    many = tagged.join(hot, tag, "left_semi").join(F.broadcast(gone.join(hot, tag, "left_semi")), tag, "left")
    return many.unionByName(tagged.join(hot, tag, "left_anti").join(gone, tag, "left"))


def _hashed(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each text: the text's place, and the two halves of the key."""
    owner, keys = [], []
    for i, text in enumerate(texts):
        found = {k for k in _keys(text, min_chars)[1] if k is not None}
        keys += found
        owner += [i] * len(found)
    hi = np.fromiter((_signed(k >> 64) for k in keys), np.int64, len(keys))
    lo = np.fromiter((_signed(k & _LOW) for k in keys), np.int64, len(keys))
    return np.array(owner, np.int64), hi, lo


def _known(filters: dict[int, CuckooFilter], n_shards: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    shard, maybe = hi % n_shards, np.zeros(len(hi), bool)
    for s, held in filters.items():
        mine = np.flatnonzero(shard == s)
        maybe[mine] = held.contains(lo[mine].view(np.uint64))
    return maybe


class CommonKeys:
    """Exact common keys, sorted, each with the tag of its first holder: what filters only guess at."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, holders: list[np.ndarray] | None):
        order = np.lexsort((hi, lo))
        self.hi, self.lo = hi[order], lo[order]
        self.holders = None if holders is None else [x[order] for x in holders]

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't common."""
        if not len(self.lo):
            return np.full(len(lo), -1)
        at = np.searchsorted(self.lo, lo)
        while True:  # equal low halves are next to each other; nearly always one step
            inside = np.minimum(at, len(self.lo) - 1)
            step = (at < len(self.lo)) & (self.lo[inside] == lo) & (self.hi[inside] < hi)
            if not step.any():
                break
            at = at + step
        inside = np.minimum(at, len(self.lo) - 1)
        return np.where((at < len(self.lo)) & (self.lo[inside] == lo) & (self.hi[inside] == hi), inside, -1)


def strip_lines(docs: DataFrame, index: LineIndex, key: str | None = "doc_id", keep_first: bool = False, text_out: bool = True, max_keys: int = MAX_KEYS) -> DataFrame:
    """``docs`` without the common lines: replaces ``text``, adds ``n_lines``, ``n_dropped``, ``kept_sha256``.

    Null or empty text is one empty line and stays what it is. Other columns are kept; rows with null or repeated keys
    are rows like others. With ``keep_first`` the row of the least ``key`` (a number; null last, then the text with the
    least hash) that holds a line keeps it; rows equal in both keep it alike. With ``text_out`` false the text is left out.
    """
    spark = docs.sparkSession
    base = docs.drop("n_lines", "n_dropped", "kept_sha256")
    tagged = _tagged(base, key if keep_first else None)
    common, n_keys = index.common(), index.common().count()
    filters = spark.sparkContext.broadcast(_filters(index)) if n_keys <= max_keys else None
    tag = F.struct("_none", "_id", "_text")
    if keep_first:
        sure = candidates(tagged, index, filters).join(common, ["hi", "lo"]) if filters is not None else confirmed(tagged, index, common)
        common = stage_table(sure.groupBy("hi", "lo").agg(F.min(tag).alias("first")).select("hi", "lo", "first.*"), "line-holders")
    if filters is not None:
        held = common.toArrow()
        column = lambda c: held.column(c).to_numpy(zero_copy_only=False)
        exact = spark.sparkContext.broadcast(CommonKeys(column("hi"), column("lo"), [column(c) for c in ("_none", "_id", "_text")] if keep_first else None))
        marked = tagged
    else:
        exact = None
        lost = confirmed(tagged, index, common if not keep_first else common.withColumnsRenamed({"_none": "_n0", "_id": "_i0", "_text": "_t0"}))
        if keep_first:
            lost = lost.filter("NOT (_none = _n0 AND _id = _i0 AND _text = _t0)")
        gone = lost.groupBy("_none", "_id", "_text").agg(F.collect_set(F.struct("hi", "lo")).alias("_common"))
        marked = _with_lost(tagged, stage_table(gone, "lost-lines"))
    out = [f for f in base.schema.fields if text_out or f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), "n_lines bigint, n_dropped bigint, kept_sha256 string"])
    names, min_chars, n_shards = [f.name for f in out], index.min_chars, index.n_shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if filters is None else {k: CuckooFilter.from_bytes(v) for k, v in filters.value.items()}
        for rows in arrow_slices(batches, "text"):
            source = rows.column("text").to_pylist()
            if known is not None:
                drop = _lost(rows, source, known, exact.value, min_chars, n_shards)
            else:
                drop = [{((c["hi"] & _LOW) << 64) | (c["lo"] & _LOW) for c in common or ()} for common in rows.column("_common").to_pylist()]
            texts, totals, dropped, digests = [], [], [], []
            for text, gone in zip(source, drop):
                lines = (text or "").split("\n")
                if gone:
                    raw, keys = _keys(text, min_chars)
                    stay = [x for x, k in zip(raw, keys) if k not in gone]
                    kept, n = b"\n".join(stay), len(raw) - len(stay)
                    texts.append(kept.decode("utf-8", "surrogatepass") if n else text)
                else:
                    kept, n = (text or "").encode("utf-8", "surrogatepass"), 0
                    texts.append(text)
                totals.append(len(lines))
                dropped.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
            made = {"text": pa.array(texts, pa.string())} if text_out else {}
            columns = [made.get(c, rows.column(c)) if c == "text" else rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], names=[*names, "n_lines", "n_dropped", "kept_sha256"])

    return marked.mapInArrow(run, schema)


def _lost(rows: pa.RecordBatch, texts: list[str | None], filters: dict, exact: CommonKeys, min_chars: int, n_shards: int) -> list[set[int]]:
    """The common keys that each text loses: known to a filter, confirmed, and not kept as their first holder."""
    at, hi, lo = _hashed(texts, min_chars)
    maybe = np.flatnonzero(_known(filters, n_shards, hi, lo))
    place = exact.find(hi[maybe], lo[maybe])
    maybe, place = maybe[place >= 0], place[place >= 0]
    if exact.holders is not None:
        own = [rows.column(c).to_numpy(zero_copy_only=False)[at[maybe]] for c in ("_none", "_id", "_text")]
        first = np.logical_and.reduce([x == y[place] for x, y in zip(own, exact.holders)])
        maybe = maybe[~first]
    out: list[set[int]] = [set() for _ in texts]
    for i, h, m in zip(at[maybe].tolist(), hi[maybe].tolist(), lo[maybe].tolist()):
        out[i].add(((h & _LOW) << 64) | (m & _LOW))
    return out


def op8_lines(docs: DataFrame) -> DataFrame:
    """The contract of operator 8 over ``documents``. Rows count as documents by their id; rows without one each for themselves."""
    rows = docs.select("doc_id", "text")
    return strip_lines(rows, build(rows, min_docs=10, min_chars=1, key="doc_id"), text_out=False)


OP8_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, doc_id, line, i, coalesce('d' || doc_id, 'r' || r) AS doc,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs)),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10)
SELECT any_value(l.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN common c USING (key)
GROUP BY l.r
"""
