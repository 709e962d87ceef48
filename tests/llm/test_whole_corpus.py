"""The corpus operators do the whole job: short texts, null and repeated ids, every language."""

import random

import pytest

import corpus_pipeline
from loomery.llm import fingerprints, quality


def test_texts_of_five_and_six_words_have_fingerprints(spark):
    texts = [" ".join(f"w{i}n{n}x{j}" for j in range(n)) for i in range(30) for n in (5, 6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, ""), (101, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(df).collect()}
    marks = [got[i].fingerprint for i in range(len(texts))]
    assert "" not in marks and len(set(marks)) == len(marks)
    assert got[100].fingerprint == got[101].fingerprint == ""
    assert all(got[i].near_next == 0 for i in range(1, len(texts)))
    assert got[100].near_next == 0.0  # an empty text before one of words
    anchors = {r.doc_id: r.anchors for r in fingerprints.anchors(df).collect()}
    assert all(anchors[i] for i in range(len(texts))) and anchors[100] == anchors[101] == []


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(seed, n=40):
    return " ".join(f"w{seed}x{j}" for j in range(n))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d = (_text(s) for s in "abcd")
    rows = [(5, a), (5, a), (None, a + " more"), (None, b), (None, b), (7, c), (7, d), (3, c), (None, "one two"), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    got = sorted([(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()], key=repr)
    assert got == sorted([(5, a), (None, b), (3, c), (7, d), (None, "one two"), (9, "")], key=repr)


def test_mixing_keeps_null_and_repeated_rows(spark):
    rows = [(None, _text(i), "en", "s", 1) for i in range(20)] + [(1, _text("z"), None, "s", None)] * 3 + [(1, _text("y"), "en", "s", 1)]
    got = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))  # one source: its target is its size


def _clean(lang, letters, n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    return [" ".join(f"{letters[:2]} {word()} {letters[2:4]} {word()}" for _ in range(40)) for _ in range(n)]


def test_every_language_has_a_reference(spark):
    langs = [(f"l{k:02d}", "".join(chr(97 + (k + 2 * j) % 26) for j in range(8))) for k in range(19)] + [("zh", "的一是不了人我在有他")]
    rows = [(lang, t) for k, (lang, letters) in enumerate(langs) for t in _clean(lang, letters, 3, k)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.op5_quality(df).collect()}
    assert len(got) == 60 and all(r.kept for r in got.values() if not r.base_failed)
    assert not any(got[i].base_failed for i, (lang, _) in enumerate(rows) if lang == "zh")


def test_many_references_as_few(spark, monkeypatch):
    rows = [(i, t, lang) for k, (lang, letters) in enumerate([("a", "abcdefgh"), ("b", "stuvwxyz"), ("zh", "的一是不了人我在有他")]) for i, t in enumerate(_clean(lang, letters, 4, k), 10 * k)]
    df = spark.createDataFrame([*rows, (90, "#1 $2 ABC " * 60, None), (91, "", "a"), (92, None, "b")], "doc_id long, text string, lang string")
    run = lambda: {r.doc_id: (r.class_distance, r.word_distance, r.kept) for r in quality.quality_rules(df).collect()}
    few = run()
    monkeypatch.setattr(quality, "UNROLLED", 0)
    for k, (c, w, kept) in run().items():
        assert kept == few[k][2] and c == pytest.approx(few[k][0], abs=1e-6) and w == pytest.approx(few[k][1], abs=1e-6)
