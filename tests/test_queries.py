"""Each registered query outside llm against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from ripplegraph import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    found = duck.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_entry_imports_without_the_optional_subpackage():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
