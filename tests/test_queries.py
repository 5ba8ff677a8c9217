"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lexweave.plans import registry

from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return repr(float(v)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    """On the smallest tables, or the next size where these give no rows: none may be empty there."""
    for sf_dir in (SMALL, SMALL.replace("0.001", "0.01")):
        df = registry.queries()[name](spark, sf_dir)
        rows = df.collect()
        if rows:
            break
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted(canonical([r[i] for i in at]) for r in found.fetchall())
    assert sorted(canonical([r[c] for c in columns]) for r in rows) == want
