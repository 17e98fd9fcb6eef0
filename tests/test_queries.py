"""Registered queries against their SQL, and the entry points."""

import duckdb
import pytest
from fieldloom.plans import registry
from fieldloom.plans.bridge import TABLES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size='2GB'; SET memory_limit='6GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.SQL:
        assert len(got) > 0
        return
    want = con.execute(registry.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: x[columns].astype(object).where(x[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(got).equals(plain(want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
