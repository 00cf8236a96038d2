"""Every query of the core against its SQL, over whole tables of the smallest size."""

import os

import duckdb
import pytest

from tessera import queries
from verify import rows_of


#: The smallest table of reports has three, all of them right; tests/test_policy.py has wrong ones. No record of the smallest catalogue passes all filters.
EMPTY = {"report_errors", "search_filtered"}


@pytest.fixture(scope="module")
def db(tiny):
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got[0]) == len(set(got[0])) and (got[1] or name in EMPTY), "no rows to compare"
    if name in queries.ORACLE:
        cur = db.execute(queries.ORACLE[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
