"""Trained operators: gradients, held-out accuracy, exact cases; and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import language, pages

SYLLABLES = {"en": "th ing er and on at es re".split(), "fr": "eau é è ç oi eux ment que".split(), "de": "ung sch ß ä keit ein ver ch".split()}


def _sample(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language.start_weights(3, 4, 0).items()}
    x, y = rng.integers(97, 105, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = language.loss_and_gradients(w, x, y)
    for name, g in grads.items():
        at = tuple(np.argwhere(np.abs(g) > 1e-4)[0])
        e = 1e-4
        w[name][at] += e
        up, _ = language.loss_and_gradients(w, x, y)
        w[name][at] -= 2 * e
        low, _ = language.loss_and_gradients(w, x, y)
        w[name][at] += e
        assert (up - low) / (2 * e) == pytest.approx(g[at], rel=1e-3), name


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.createDataFrame(_sample(300, 1), "doc_id long, text string, lang string"), steps=80)


def test_language(spark, model, docs, rows, empty):
    held = _sample(200, 2)
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.9
    mixed = language.predict(docs.withColumn("lang_pred", F.lit("x")), model).collect()
    assert len(mixed) == len(rows)
    for r in mixed:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.predict(empty, model).count() == 0
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_prediction_reads_the_text_alone_and_all_of_it(spark, model):
    fr, en = "eau é è oi " * 60, "thing and on er " * 5
    df = spark.createDataFrame([(1, en + fr, "en"), (2, en + fr, None), (3, en, "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert got[1] == got[2] and got[1][0] == "fr" and got[3][0] == "en"


def test_op9_sees_no_held_out_labels(spark):
    df = spark.createDataFrame(_sample(120, 3), "doc_id long, text string, lang string")
    spoiled = df.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    found = language.op9_language(spoiled)
    assert found.filter("lang_pred = 'zz'").count() == 0


@pytest.mark.parametrize("known", [1.0, 0.0])
def test_pages_hold_out(known):
    """Other pages than those learned from, with usual names and with made-up ones only."""
    model = pages.default_model()
    right = total = 0
    for page in pages.labelled_pages(60, seed=77, known=known):
        nodes = pages.parse(page)
        model.marginals(nodes)
        for x in nodes:
            if x.tag == "#":
                total += 1
                right += (x.down > 0.5) == x.label
    assert right / total > (0.98 if known else 0.95)


PARTS = [
    ("<article><h1>T</h1><p>Some long sentence that is the text of the article, at length.</p><ul><li>one</li><li>two</li></ul><p>More of it follows here, a full sentence.</p></article>",
     "T\nSome long sentence that is the text of the article, at length.\none\ntwo\nMore of it follows here, a full sentence."),
    ("<p>This is a full sentence that makes up the page.</p>", "This is a full sentence that makes up the page."),
    ("<body><article><h2>Title</h2><p>A first paragraph with some words in it.</p><figure><img src=x><figcaption>A caption</figcaption></figure></article><div class='opinions'><h3>What readers say</h3>"
     "<div><p>I liked this very much, thank you.</p></div><div><p>Me too, what a good piece this is!</p></div></div><div class='legalese'>All rights reserved by Someone Inc.</div></body>", "Title\nA first paragraph with some words in it.\nA caption"),
    ("<nav><a href=/>Home</a></nav><article><p>Short text.</p></article><footer>x</footer>", "Short text."),
    # what stands inside the article without being its text
    ("<article><h1>Title of this</h1><p>Some long sentence that is the text of the article, at length.</p><p>Another long sentence of the article follows it here.</p><section class='comments'><h3>Comments</h3>"
     "<p>I liked this very much, thank you.</p><p>Me too, what a good piece this is!</p></section></article>",
     "Title of this\nSome long sentence that is the text of the article, at length.\nAnother long sentence of the article follows it here."),
    ("<article><h1>Title of this</h1><p>Some long sentence that is the text of the article, at length.</p><div class='comment-list'><div class='comment'><b>Ann</b><p>I liked this very much, thank you.</p></div>"
     "<div class='comment'><b>Bob</b><p>Me too, what a good piece this is!</p></div></div></article>", "Title of this\nSome long sentence that is the text of the article, at length."),
    ("<main><h1>Title of this</h1><p>Some long sentence that is the text of the article, at length.</p><div class='related'><h4>Related articles</h4><ul><li><a href=x>One other story of it</a></li><li><a href=y>Second other"
     " story</a></li></ul></div><p>Last paragraph of the story is here to be read.</p><form><label>Your mail</label><p>Sign up for our letter and get news every day.</p><input></form></main>",
     "Title of this\nSome long sentence that is the text of the article, at length.\nLast paragraph of the story is here to be read."),
    ("<article><h1>T</h1><p>Some long sentence that is the text of the article, at length.</p><aside><h3>About</h3><p>The author is a person who writes things for us.</p></aside><p>Another long sentence of the article"
     " follows it here.</p><footer><p>Filed under things</p></footer></article>", "T\nSome long sentence that is the text of the article, at length.\nAnother long sentence of the article follows it here."),
]


@pytest.mark.parametrize(("page", "text"), PARTS)
def test_lists_captions_and_bare_pages(page, text):
    assert pages.default_model().text(page) == text


@pytest.mark.parametrize("part", ["<div>", "</p>", "<b>", "</i>", "<b><div>", "</b>", "<li>x", "<a href=x>y", "<p>word ", "<x 'y>", "&amp;"])
def test_long_hostile_pages(part):
    import time

    began = time.time()
    pages.default_model().text((part + ("</p>" if part == "<div>" else "")) * (1_000_000 // len(part)))
    assert time.time() - began < 60


def test_pages_cases(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"
        "<div class='cookie-banner'>We use cookies to improve the site and to measure visits.</div><article><h1>A &amp; B</h1><p><b>First   part\nof it.<br><p>Second &lt;tag&gt; part&nbsp;here, which is long enough to be text.</p></article>"
        "<section class='comments'><h3>Comments</h3><div class='comment'><p>I liked this very much, thank you for it.</p></div></section><footer>&copy; 2020 Someone</footer>"
    )
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<p>" * 5000 + "deep", None), (5, "u", "a < b <!-- open", "x"), (5, "u", "<div", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert got[1].text == "A & B\nFirst part of it.\nSecond <tag> part here, which is long enough to be text."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert pages.op7_pages(df).count() == 6 and pages.op7_pages(df.limit(0)).count() == 0


def test_sum_product_against_enumeration():
    from itertools import product
    from math import exp, log

    model = pages.TreeModel(pages.labelled_pages(30, seed=5))
    nodes = pages.parse("<body><div class=content><p>Some words of text here.</p><p>x</p></div><div class=ad>Buy it</div></body>")
    model.marginals(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    total, on = 0.0, [0.0] * len(nodes)
    for states in product((0, 1), repeat=len(nodes)):
        s = 0.0
        for i, x in enumerate(nodes):
            odds = model.damped[x.tag == "#"] * sum(model.weight.get(f, 0.0) for f in pages.features(x)) + (-4.0 if i == 0 else 0.0)
            s += odds * states[i]
            if i:
                p = model.edge(x)[states[place[id(x.parent)]]]
                s += log(p if states[i] else 1 - p)
        total += exp(s)
        for i, v in enumerate(states):
            on[i] += exp(s) * v
    for x, v in zip(nodes, on):
        assert x.down == pytest.approx(v / total, abs=1e-9)


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.filter("doc_id IS NOT NULL AND doc_id <> 93").select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == columns, name
        kept = corpus_pipeline.stage_table(out, "test")
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert not {80, 81, 82, 85, 86} & set(texts)  # nothing to read
    assert len(set(texts) & set(range(60, 79))) <= 2  # near copies
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.filter("NOT same").count() == 0 and final.count() == kept.count()
