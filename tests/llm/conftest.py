import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, sketch string, _tie long"


def _words(rng, n, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and very long texts, ties, copies, near copies; clashing extra columns."""
    rng = random.Random(1)
    out = []
    for i in range(60):
        text = "\n".join(_words(rng, rng.randrange(5, 40), "abcdefgh") for _ in range(rng.randrange(1, 6)))
        out.append([i, text, "en", f"s{i % 4}"])
    base = _words(rng, 120, "ijklmnop")
    for i in range(60, 75):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append([i, " ".join(w) + "\nThe same last line", "de", "s0"])
    out += [[75, base, "de", "s0"], [76, base, "de", None], [77, base.upper(), "de", "s1"]]
    out += [[80, None, None, None], [81, "", "en", "s1"], [82, " \t\n ", "en", "s1"], [83, "one two", "en", "s2"], [84, "One  TWO", "en", "s2"], [85, "\n\n\n", "en", "s2"], [86, "12345 !!", "en", "s3"]]
    out += [[90, _words(rng, 8000, "qrstuvwxyz"), "en", "s3"], [91, "é" * 3000, "fr", "s3"], [92, "Ünï çödé 漢字 😀 text", "fr", "s3"]]
    out += [[None, "no id here but some words", "en", "s1"], [93, "repeated row", "en", "s1"], [93, "repeated row", "en", "s1"]]
    return [(*x, None, "extra", "extra", "extra", 7) for x in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
