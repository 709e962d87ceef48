"""Every query with SQL gives the same rows in DuckDB, on small driver tables."""

import math
import os

import pytest

from loomery.plans import catalogue

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else float(f"{float(v):.7g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v).replace("+00:00", "")


def same(x, y):
    """Equal, or numbers that differ in the last place that is rounded."""
    if isinstance(x, float) and isinstance(y, float):
        return abs(x - y) <= 1.5e-6 + 1e-6 * abs(y)
    return x == y


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert all(same(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    """Queries without SQL; their results are held against plain versions in the other tests."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    df = catalogue.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
