"""Every registered query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from starling.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).lower().startswith(("int", "uint", "float")):
            frame = frame.assign(**{c: frame[c].astype(float).round(5)})
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_is_callable():
    assert all(map(callable, catalog.queries().values())) and set(catalog.oracle_sql()) <= set(catalog.queries())
