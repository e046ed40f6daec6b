"""Every query that has a DuckDB twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from runlattice.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def values(frame):
    """Rows in order; floats to nine digits, as the two engines may differ in the last."""
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(repr([f"{v + 0.0:.9g}" if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    assert values(catalog.QUERIES[name](spark, SF).toPandas()) == values(duck.execute(catalog.ORACLES[name]).df())
