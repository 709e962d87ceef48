"""Results of the methods themselves against plain versions: syncmers, distances, schedules, networks, and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm import fingerprints, jaccard, language, lines, mixing, quality

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


# -- fingerprints ------------------------------------------------------------------------------------------------------
def _hash(values):
    """Spark's xxhash64 of numbers: each hashed with the hash before as its seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64((v & (1 << 64) - 1).to_bytes(8, "little"), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def _plain_anchors(text):
    k, s = fingerprints.K, fingerprints.S
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(text)]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    small = [_hash(h[i : i + s]) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        inside = small[i : i + k - s + 1]
        if min(inside) in (inside[0], inside[-1]):
            out.append((i, _hash(inside)))
    return out


def _plain_sketch(text):
    found = sorted({h & 0xFFFFFFFF for _, h in _plain_anchors(text)})[: fingerprints.SKETCH]
    return found


def _plain_likeness(a, b):
    union = sorted(set(a) | set(b))[: fingerprints.SKETCH]
    return 1.0 if not union else len(set(a) & set(b) & set(union)) / len(union)


def test_syncmers_sketches_and_likeness(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(8, 700))) for _ in range(25)]
    df = spark.createDataFrame([(i * 3 + (1 << 60) * (i == 24), t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprints.anchors(df).collect()}
    rows = {r.doc_id: r for r in fingerprints.op1_fingerprints(df).collect()}
    ids = sorted(rows, reverse=True)
    known = dict(df.collect())
    for at, i in enumerate(ids):
        text, after = known[i], known[ids[(at + 1) % len(ids)]]
        assert [(a.pos, a.hash) for a in found[i].anchors] == _plain_anchors(text)
        sketch = _plain_sketch(text)
        assert rows[i].fingerprint == "".join(f"{h:08x}" for h in sketch)
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        assert rows[i].near_edited == pytest.approx(_plain_likeness(sketch, _plain_sketch(edited)))
        assert rows[i].near_next == pytest.approx(_plain_likeness(sketch, _plain_sketch(after)))


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_successors_of_odd_ids(spark, monkeypatch, kind):
    """Ids far apart, null, repeated, or texts: blocks stay small and the order is right."""
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 4)
    rng = random.Random(1)
    ids = [rng.randrange(200) for _ in range(60)] + [7] * 30 + [None] * 30 + [1 << 60, -5]
    ids = [None if x is None else {"string": f"k{x}", "long": x, "double": x / 4}[kind] for x in ids]
    rows = [(x, zlib.crc32(str(i).encode())) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, _tie long")
    got = {r._tie: r.next__tie for r in fingerprints.with_next(df, ["_tie"]).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])
    order = sorted(order, key=lambda r: r[0].encode() if kind == "string" else r[0], reverse=True) + sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    assert got == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    placed, _ = fingerprints.key_blocks(df, "doc_id", "_tie")
    assert max(r["count"] for r in placed.groupBy("_block").count().collect()) <= 24


# -- quality -----------------------------------------------------------------------------------------------------------
def _js(p, q):
    h = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    return math.sqrt(max(0.0, h([(a + b) / 2 for a, b in zip(p, q)]) - (h(p) + h(q)) / 2))


def _classes(text):
    out = Counter()
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            continue
        kind = "lower" if c.islower() else "stop" if c in ".," else "digit" if c.isdecimal() else "symbol" if c in "#*$%&|<>" else "upper" if c.isalpha() else "other"
        out[kind] += 1
    return [out[k] for k in quality.CLASSES]


def test_plain_divergence(spark):
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ".", ","]) for _ in range(n))
    rows = [(i, make("abcdeé", rng.randrange(10, 200)), "a") for i in range(30)] + [(100 + i, make("uvwxyzABC12", rng.randrange(30, 200)), "b") for i in range(30)]
    rows += [(300, "#1 $2 %% ABC " * 60, None), (301, "the quick brown fox " * 3, None), (302, make("κλμνξ", 150), None), (303, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = {}
    for lang in ("a", "b"):
        texts = [t or "" for _, t, la in rows if la == lang]
        c, w = np.sum([_classes(t) for t in texts], axis=0), Counter(x for t in texts for x in words(t))
        top = sorted(w.items(), key=lambda kv: (-kv[1], kv[0]))[:16]
        shares = [n / sum(w.values()) for _, n in top]
        refs[lang] = (c / c.sum(), [x for x, _ in top], [*shares, 1 - sum(shares)])
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, text, _ in rows:
        ws, c = words(text), _classes(text or "")
        by_class = min(_js([x / max(1, sum(c)) for x in c], ref[0]) for ref in refs.values())
        seen = [[sum(w == x for w in ws) / max(1, len(ws)) for x in ref[1]] for ref in refs.values()]
        by_word = min(_js([*s, 1 - sum(s)], ref[2]) for s, ref in zip(seen, refs.values()))
        r = got[i]
        assert r.class_distance == (pytest.approx(by_class, abs=1e-6) if sum(c) >= 200 else None), i
        assert r.word_distance == (pytest.approx(by_word, abs=1e-6) if len(ws) >= 50 else None), i
        fine = (sum(c) < 200 or by_class <= 0.32) and (len(ws) < 50 or by_word <= 0.40)
        assert r.kept == (fine and not r.base_failed), i


# -- mixing ------------------------------------------------------------------------------------------------------------
def test_plain_schedule(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["s0", "s1", "s2", "s2", "s2", None]), rng.randrange(0, 60)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r.doc_id: r for r in mixing.mix(df, max_block=8, least_blocks=20).collect()}
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    size = {s: sum(z for _, x, z in rows if x == s) for s in names}
    target = {s: next(r.target for r in got.values() if rows[r.doc_id][1] == s) for s in names}
    block = {s: max(1, min(8, size[s] // 20)) for s in names}
    weights = [target[s] / block[s] for s in names]
    upto = np.cumsum(weights) / sum(weights)
    rank, uses = Counter(), Counter()
    for i in range(math.ceil(sum(weights))):
        point = int(f"{i & (1 << 32) - 1:032b}"[::-1], 2) / 2**32
        s = names[int(np.searchsorted(upto, point, side="right"))]
        n = -(-size[s] // block[s])
        if rank[s] < 3 * n:
            uses[s, rank[s] % n] += 1
        rank[s] += 1
    at, taken = Counter(), Counter()
    for i, s, z in sorted(rows, key=lambda r: hashlib.md5(f"29:{r[0]}".encode()).hexdigest()):
        for t in range(at[s], at[s] + z):
            taken[i] += uses[s, t // block[s]]
        at[s] += z
    assert {i: r.taken for i, r in got.items()} == {i: taken[i] for i, _, _ in rows}


# -- language ----------------------------------------------------------------------------------------------------------
def test_plain_network():
    rng = np.random.default_rng(2)
    weights = language.start_weights(3, 4, 9)
    weights["b"] = rng.standard_normal((3, 1)).astype(np.float32)
    model = language.Model(["x", "y", "z"], weights)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(window, side):
        h, out = np.zeros(4), []
        for b in window if side == "f" else window[::-1]:
            a, g = weights["e" + side][b].astype(float), weights["u" + side].astype(float) @ h
            z, r = sig(a[:4] + g[:4]), sig(a[4:8] + g[4:8])
            h = z * h + (1 - z) * np.tanh(a[8:] + r * g[8:])
            out.append(h)
        return out if side == "f" else out[::-1]

    texts = ["short one", "a longer text, of several windows. " * 9, "é漢😀" * 40, None, ""]
    got = language.document_probabilities(model, texts)
    for text, row in zip(texts, got):
        if not text:
            assert (row == 0).all()
            continue
        raw = text.encode()
        raw += (raw + b" " * language.WIDTH)[: -len(raw) % language.WIDTH]
        shares = []
        for i in range(0, len(raw), language.WIDTH):
            w = raw[i : i + language.WIDTH]
            for f, b in zip(states(w, "f"), states(w, "b")):
                logit = weights["w"].astype(float) @ np.concatenate([f, b]) + weights["b"][:, 0]
                p = np.exp(logit - logit.max())
                shares.append(p / p.sum())
        assert row == pytest.approx(np.mean(shares, axis=0), abs=2e-4)


# -- pipeline ----------------------------------------------------------------------------------------------------------
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def _plain_line_dedup(rows):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    digest = lambda t: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    holders = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        for k in {norm(x) for x in (text or "").split("\n")} - {""}:
            holders[k].append((doc_id is None, doc_id or 0, digest(text)))
    first = {k: min(v) for k, v in holders.items() if len(v) >= 10}
    out = []
    for doc_id, text, lang, source, _ in rows:
        own = (doc_id is None, doc_id or 0, digest(text))
        kept = "\n".join(x for x in (text or "").split("\n") if norm(x) not in first or first[norm(x)] == own)
        if text is not None and words(kept):
            out.append((doc_id, kept, lang, source, len(kept)))
    return sorted(out, key=repr)


def _plain_near(rows):
    sets = []
    for _, text, *_ in rows:
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    best = {}
    for i, r in enumerate(rows):
        name = (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
        best[group[i]] = min(best.get(group[i], (name, i)), (name, i))
    return sorted((rows[i] for _, i in best.values()), key=repr)


def test_pipeline_against_plain_stages(spark, docs, empty, tmp_path):
    """Every stage on rows with null and repeated ids, empty texts and clashing columns; then on no rows."""
    data = docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS, F.lit(1).alias("_row"), F.lit("x").alias("common"))
    kept = data.persist()
    known = language.fit(kept.filter(~language.held_out()).select("doc_id", "text", "lang"))
    scored = language.predict(kept, known).collect()
    one = corpus_pipeline.language_id(spark, kept, "")
    assert one.columns == data.columns
    assert _rows(one) == sorted((tuple(r[c] for c in COLUMNS) for r in scored if r.lang_pred != "und" and r.score >= known.floor), key=repr)
    assert all(r.score >= known.floor for r in scored if r.doc_id is not None and r.doc_id < 60)  # clean documents stay
    base = _rows(kept)
    two = corpus_pipeline.line_dedup(spark, kept, "")
    assert two.columns == data.columns and _rows(two) == _plain_line_dedup(base)
    three = corpus_pipeline.near_duplicates(spark, kept.drop("_row"), "")
    assert _rows(three) == _plain_near(base)
    four = corpus_pipeline.mix_sources(spark, kept.select(*COLUMNS), "")
    mixed, sizes = Counter(_rows(four)), {r: len(words(r[1])) for r in base}
    assert set(mixed) <= set(base) and all(n <= 3 * base.count(r) for r, n in mixed.items())
    took, whole = Counter(), Counter()
    for r in base:
        whole[r[3]] += sizes[r]
    for r, n in mixed.items():
        took[r[3]] += n * sizes[r]
    targets = {r.src: r.target for r in mixing.source_targets(spark.createDataFrame([("1" if s is None else "0" + s, n) for s, n in whole.items()], "src string, source_size long")).collect()}
    largest = max(sizes.values())
    assert all(abs(took[s] - targets["1" if s is None else "0" + s]) <= largest + 0.1 * whole[s] for s in whole)
    five = corpus_pipeline.encode(spark, kept.select(*COLUMNS), "").collect()
    sentencepiece = pytest.importorskip("sentencepiece")
    from loomery.llm.queries import vocabulary

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    encoded = Counter((r.doc_id, tuple(r.ids)) for r in five)
    assert encoded == Counter((r[0], tuple(library.encode(r[1] or ""))) for r in base)
    none = kept.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*COLUMNS), "").count() == 0, name


def test_lines_index_of_no_rows(spark, empty):
    assert lines.strip_lines(empty, lines.build(empty)).count() == 0 and jaccard.link_components(empty).count() == 0
