"""Fill-in-middle against plain cuts by patterns, on all units; outputs rebuilt exactly."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import infill

PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"[\x09-\x0D\x20]*[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+",
    "class": r"\n|[\x09\x0B-\x0D\x20]+|(?:[0-9A-Za-z_]|[^\x00-\x7F])+|[^\n\x09\x0B-\x0D\x200-9A-Za-z_\x80-\U0010FFFF]+",
    "char": r"(?s:.)",
}
TEXT = st.text(alphabet="ab_ 9\n\n\t\r.-é漢😀", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(sorted(PATTERNS)))
def test_cuts_are_those_of_the_units(text, unit):
    units = re.findall(PATTERNS[unit], text)
    assert "".join(units) == text
    found = infill.runs(text.encode(), unit)
    assert found.n == len(units)
    for c in range(len(units) + 1):
        assert found.cut(c) == len("".join(units[:c]).encode())


def plain(doc_id, text):
    text = text or ""
    lines = re.findall(PATTERNS["line"], text)
    n, h = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


MORE = [(200, "a <P> in it\nb"), (201, "<S"), (202, "<M>"), (203, "\n" * 5000), (204, "<\n<P\nS>\n<S\n>"), (205, "no end\nof line"), (206, "\r\n\r\n"), (207, "x" * 300_000 + "\n" + "é\n" * 40_000)]


def test_infill(spark, docs, rows, empty):
    extra = spark.createDataFrame([(i, t, None, None, 1, "size", "n", "form", 2) for i, t in MORE], docs.schema)
    both = docs.unionByName(extra)
    made = infill.fill_in_middle(both.withColumn("form", both.size)).collect()  # a clashing name is replaced
    want = sorted(map(repr, (plain(*r[:2]) for r in [*rows, *MORE])))
    assert sorted(repr((r.n, r.form, r.output, r.prefix_chars, r.middle_chars)) for r in made) == want
    assert all(r.target in ("extra", "n") and r._tie in (7, 2) for r in made)  # other columns pass through
    got = infill.op12_infill(both).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(repr((r.doc_id, r.n, r.form, r.output_sha256, r.restored_sha256)) for r in got) == sorted(
        repr((i, *plain(i, t)[:2], digest(plain(i, t)[2]), digest(t or ""))) for i, t, *_ in [*rows, *MORE]
    )
    assert infill.op12_infill(empty).count() == 0
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_parameters(spark, docs):
    none = infill.fill_in_middle(docs, fim_percent=0).collect()
    assert {r.form for r in none} == {"plain"} and all(r.output == (r.text or "") for r in none)
    words = infill.fill_in_middle(docs, unit="word", seed=3, spm_percent=0, marks=infill.Marks("[pre]", "[suf]", "[mid]"))
    back = infill.restore(words, marks=infill.Marks("[pre]", "[suf]", "[mid]")).collect()
    assert all(r.restored == (r.text or "") for r in back) and {r.form for r in back} == {"plain", "psm"}
    strange = spark.createDataFrame([("x", "unknown"), (None, "psm")], "output string, form string")
    assert [r.restored for r in infill.restore(strange).collect()] == [None, None]


@pytest.mark.parametrize("marks", [("<a", "a>", "b"), ("aa", "b", "c"), ("x", "x", "y"), ("ab", "xabx", "c"), ("", "a", "b")])
def test_marks_that_could_be_misread(marks):
    with pytest.raises(ValueError):
        infill.Marks(*marks).checked()
