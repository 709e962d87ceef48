"""Operators against plain versions, on documents with nulls, empties, ties, copies, and columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomery.llm import fingerprints, jaccard, lines, mixing, quality, sharding

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def test_fingerprints(docs, rows, empty):
    some = docs.filter("doc_id <> 93")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(some).collect()}
    known = {r[0]: r[1] or "" for r in rows if r[0] != 93 and r[0] is not None}
    ids = sorted(known, reverse=True)
    assert set(got) == set(ids)
    for i, k in enumerate(ids):
        text, after = known[k], known[ids[(i + 1) % len(ids)]]
        m = len(text) // 3
        assert got[k].n_chars == len(text)
        assert got[k].edited_sha256 == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[75].fingerprint == got[76].fingerprint != got[77].fingerprint
    assert got[80].fingerprint == "" and got[90].near_edited > 0.3
    assert fingerprints.op1_fingerprints(docs).count() == len(rows)  # with null and repeated ids
    assert fingerprints.op1_fingerprints(empty).count() == 0
    one = fingerprints.op1_fingerprints(docs.filter("doc_id = 90")).collect()
    assert one[0].near_next == 1.0  # its own successor


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"w{i * 7919 % 100}x{i}" for i in range(40))
    df = spark.createDataFrame([(1, "aa bb " + passage), (2, passage + " cc"), (3, None), (4, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.anchors for r in fingerprints.anchors(df).collect()}
    assert {(a.pos - 2, a.hash) for a in got[1] if 2 <= a.pos < 38} == {(a.pos, a.hash) for a in got[2] if a.pos < 36}
    assert got[3] == [] and len(got[4]) == 1


def test_sharding(docs, rows, empty):
    got = sharding.op3_sharding(docs).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    expected = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    assert sharding.op3_sharding(empty).count() == 0


def test_interleaving_is_the_plain_one(spark):
    """Every row's shard and slot: ranks by digest within sources, fractions of ranks, the sequence cut into equal parts."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(6)
    for n_shards, seed in ((1, 17), (7, 3)):
        by_source = defaultdict(list)
        for i, s in rows:
            by_source["1" if s is None else "0" + s].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        order = sorted(((r + 0.5) / len(v), s, r, i) for s, v in by_source.items() for r, (_, i) in enumerate(sorted(v)))
        want, counts = {}, Counter()
        for pos, (*_, i) in enumerate(order):
            shard = pos * n_shards // len(rows)
            want[i] = (shard, counts[shard])
            counts[shard] += 1
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, n_shards, seed).collect()} == want


def test_equal_rows_without_id_are_spread(spark):
    """A third of all rows without id and text: no cell of the order holds many of them."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    got = sharding.op3_sharding(df).filter("doc_id IS NULL").groupBy("shard").count().collect()
    assert len(got) == 24 and max(r["count"] for r in got) < 150


def test_shards_match_the_mixture(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    whole = {r.source: r["count"] for r in df.groupBy("source").count().collect()}
    for r in sharding.interleave(df, 10).groupBy("shard", "source").count().collect():
        assert abs(r["count"] - whole[r.source] / 10) <= 2


def _plain_repeats(ws):
    spots = defaultdict(list)
    for i in range(len(ws) - 7):
        spots[tuple(ws[i : i + 8])].append(i)
    return len({j for v in spots.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_quality_base(spark, docs, rows, empty):
    extra = spark.createDataFrame([(200, "a b c d e f g h " * 6 + "x\nx\n \nx", "en"), (201, "## |x| $1 &<>", None), (202, " ".join(["la"] * 30), "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.op5_quality(docs.select("doc_id", "text", "lang").unionByName(extra)).collect() if r.doc_id != 93}
    plain = [r[:2] for r in rows if r[0] != 93] + [(200, "a b c d e f g h " * 6 + "x\nx\n \nx"), (201, "## |x| $1 &<>"), (202, " ".join(["la"] * 30))]
    for k, text in plain:
        ws, seen, dup = words(text), set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        repeats = _plain_repeats(ws)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeats), k
        assert r.base_failed == (len(ws) < 20 or 100 * repeats > 30 * len(ws))
        assert not (r.kept and r.base_failed)
    assert quality.op5_quality(empty).count() == 0
    assert quality.op5_quality(docs.withColumn("lang", F.lit(None).cast("string"))).filter("kept = base_failed").count() == 0  # no references


def test_quality_divergence(spark):
    rng = random.Random(8)
    clean = [(i, " ".join(f"the of and {''.join(rng.choice('abcdefgh') for _ in range(6))}" for _ in range(40)), "en") for i in range(40)]
    junk = [(100, " ".join(f"w{j}###%%%$$$" for j in range(80)), "en")]
    got = {r.doc_id: r.kept for r in quality.op5_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(40)) and not got[100]


def test_points_of_the_schedule(spark):
    """The van der Corput sequence in base 2, beyond 2 ** 32 too."""
    ids = [0, 1, 2, 3, 6, 12345, (1 << 32) - 1, 1 << 32, (1 << 32) + 1, (1 << 45) + 77]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixing.van_der_corput(F.col("i")).alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: sum((i >> k & 1) / 2.0 ** (k + 1) for k in range(52)) for i in ids}


def test_mixing(docs, rows, empty):
    got = mixing.op6_mixing(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        left, w = total - sum(target.values()), sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / w > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            target[k] = 3 * sizes[k]
            free.discard(k)
    target |= {k: left * weight[k] / w for k in free}
    taken = defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        k = source[r.doc_id]
        assert r.source_size == sizes[k] and r.target == pytest.approx(target[k]) and 0 <= r.taken <= 3 * r["size"]
        taken[k] += r.taken
    for k in order:
        assert abs(taken[k] - target[k]) <= max(20, 0.01 * target[k]), k
    again = mixing.op6_mixing(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.op6_mixing(empty).count() == 0


def _plain_lines(texts, least):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for t in texts for k in {norm(x) for x in (t or "").split("\n")} if k)
    common = {k for k, n in held.items() if n >= least}
    return [[x for x in (t or "").split("\n") if norm(x) not in common] for t in texts]


def test_line_dedup(docs, rows, empty):
    data = docs.filter("doc_id IS NOT NULL AND doc_id <> 93")
    known = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 93}
    plain = dict(zip(known, _plain_lines(known.values(), 10)))
    got = {r.doc_id: r for r in lines.op8_lines(data).collect()}
    assert set(got) == set(known)
    for k, kept in plain.items():
        n = (known[k] or "").count("\n") + 1
        assert (got[k].n_lines, got[k].n_dropped) == (n, n - len(kept))
        assert got[k].kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert sum(r.n_dropped for r in got.values()) >= 15
    assert lines.op8_lines(docs).count() == len(rows) and lines.op8_lines(empty).count() == 0


def test_line_index_is_reversible(spark):
    df = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(12)], "doc_id long, text string")
    index = lines.build(df, min_docs=10)
    dropped = lambda ix: sum(r.n_dropped for r in lines.strip_lines(df, ix).collect())
    assert dropped(index) == 12
    fewer = lines.update(index, deleted=df.filter("doc_id < 3"))
    assert dropped(fewer) == 0
    more = lines.update(fewer, inserted=df.filter("doc_id < 3"))
    assert dropped(more) == 12 and more.counts.count() == index.counts.count()
    assert dropped(lines.LineIndex(index.counts, index.filters, 10, 1, index.n_shards)) == 12
    first = lines.strip_lines(df, index, keep_first=True).filter("n_dropped = 0").collect()
    assert [r.doc_id for r in first] == [0]
    for keep in (False, True):  # the way without filters gives the same
        one, two = (sorted(map(tuple, lines.strip_lines(df, index, keep_first=keep, max_keys=k).collect())) for k in (lines.MAX_KEYS, -1))
        assert one == two


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(i, "shared\nown") for i in range(8)] + [(None, "shared"), (None, "SHARED \n x")] + [(20, "twice"), *[(i, "twice") for i in range(21, 29)], (20, "twice\nmore")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped) for r in lines.op8_lines(df).collect()), key=repr)
    assert [x for x in got if x[0] is None] == [(None, 1, 1), (None, 2, 1)]  # ten documents hold "shared", two of them without id
    assert [x for x in got if x[0] == 20] == [(20, 1, 0), (20, 2, 0)]  # ten rows, but nine documents hold "twice"
    kept = lines.strip_lines(df, lines.build(df, 10), keep_first=True).filter("text LIKE '%shared%' OR text LIKE '%SHARED%'").collect()
    assert [r.doc_id for r in kept] == [0]


def test_line_filters_in_slices(spark, docs, monkeypatch):
    """Beyond the keys that are sent, filters go in slices and are asked all the same; a text with very many copies is no single key."""
    from pyspark.sql import functions as F

    copies = spark.createDataFrame([(1000 + i, "copied line\nand another\nshared " + str(i % 3)) for i in range(1200)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(copies)
    index = lines.build(both, min_docs=10, keys_per_shard=2)
    monkeypatch.setattr(lines, "FILTER_BYTES", 100)
    for keep in (False, True):
        one, two = (sorted(map(repr, lines.strip_lines(both, index, keep_first=keep, max_keys=k).collect())) for k in (lines.MAX_KEYS, -1))
        assert one == two and len(one) == both.count()
    none = index.filters.withColumn("bits", F.lit(bytes(lines.CuckooFilter.sized(1).to_bytes())))
    asked = lines.strip_lines(both, lines.LineIndex(index.counts, none, 10, 1, index.n_shards), max_keys=-1)
    assert asked.agg(F.sum("n_dropped")).first()[0] == 0  # empty filters know no line


def test_line_sql_with_null_and_repeated_ids(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, "shared\nown") for i in range(8)] + [(None, "shared"), (None, "SHARED \n x"), (None, None)] + [(20, "twice"), *[(i, "twice") for i in range(21, 29)], (20, "twice\nmore")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by the SQL
    ours = lines.op8_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, duckdb.sql(lines.OP8_SQL).fetchall()))


def test_cuckoo_filter():
    import numpy as np

    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 20000, dtype=np.int64).view(np.uint64))
    made = lines.CuckooFilter.of(h)
    assert made.contains(h).all()
    assert made.contains(rng.integers(0, 1 << 63, 20000, dtype=np.int64).view(np.uint64)).mean() < 0.01
    made.delete(h[:10000])
    assert made.contains(h[10000:]).all() and made.contains(h[:10000]).mean() < 0.01
    assert lines.CuckooFilter.from_bytes(made.to_bytes()).contains(h[10000:]).all()


def _plain_components(texts, percent, k):
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("percent", "k"), [(85, 4), (80, 5)])
def test_jaccard_components(docs, rows, percent, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs.filter("doc_id <> 93"), percent, k).collect()}
    assert got == _plain_components({r[0]: r[1] for r in rows if r[0] is not None and r[0] != 93}, percent, k)


def test_jaccard_edges(docs, rows, empty):
    got = jaccard.op4_jaccard(docs).collect()
    assert len(got) == len(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert [r.component_id for r in got if r.doc_id == 93] == [93, 93]
    assert jaccard.op4_jaccard(empty).count() == 0


def test_jaccard_with_frequent_tokens(spark, monkeypatch):
    """Combinations of two and three tokens decide when almost all tokens are frequent."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "PAIRED", 2)
    monkeypatch.setattr(jaccard, "SMALL_LIST", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30)) for _ in range(6)]
    texts = {}
    for i in range(90):
        w = " ".join(rng.sample(pool, 4) if i % 2 else pool[:4]).split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(df, 80, 3).collect()}
    assert got == _plain_components(texts, 80, 3)


def test_quality_can_be_filtered(spark, docs):
    """A filter on what the rules add is not written out into their arrays: it ends in seconds, with the rows of the whole."""
    import time

    repetitive = spark.createDataFrame([(i, "over and over again " * (30 + i % 7), "en", "s", 1, "", "", "", 1) for i in range(400)], docs.schema)
    both = docs.unionByName(repetitive)
    rows = quality.quality_rules(both).collect()
    began = time.time()
    kept = quality.quality_rules(both).filter("kept").filter("n_repeat_words >= 0 AND class_distance >= 0").collect()
    assert time.time() - began < 40
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in rows if r.kept and r.class_distance is not None)


def test_quality_forms_of_distance_agree(docs, monkeypatch):
    """References unrolled into the plan, and held as one constant array, give the same distances."""
    found = []
    for unrolled in (16, 0):
        monkeypatch.setattr(quality, "UNROLLED", unrolled)
        found.append(sorted((r.doc_id or -1, r.text or "", round(r.class_distance or -1, 9), round(r.word_distance or -1, 9)) for r in quality.quality_rules(docs).collect()))
    assert found[0] == found[1]
