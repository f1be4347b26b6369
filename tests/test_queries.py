"""Every registered query that has SQL agrees with it."""

import duckdb
import pytest

from linkloom.jobs import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    """Cells as text; null is told from the empty text."""
    return sorted(tuple("null" if v is None else f"={float(v):.6f}" if isinstance(v, float) else f"={v}" for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain(want)
