"""Every core query against its SQL on the smallest shared tables."""

import os
from pathlib import Path

import duckdb
import pytest

from foliant import conversion_queries as q

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, name):
    found = q.QUERIES[name](spark, str(DATA)).toPandas()
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    wanted = db.sql(q.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows(found, columns) == rows(wanted, columns)
    assert len(found)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
