"""Each query of this subpackage that SQL can express, against its SQL over the smallest tables."""

import os

import duckdb
import pytest

from ripplegraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(Q.oracle_sql()[name])
    cols = sorted(d[0] for d in found.description)
    order = [d[0] for d in found.description]
    want = [[r[order.index(k)] for k in cols] for r in found.fetchall()]
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == cols
    plain = lambda rows: sorted(str([None if v is None else v if isinstance(v, str) else int(v) for v in r]) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(want)
