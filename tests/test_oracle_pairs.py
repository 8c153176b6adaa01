"""Every registered query against its DuckDB oracle on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_sql import ORACLE
from tests.conftest import SF_SMALL
from tests.helpers import canon, duck_rows, spark_rows
from txmon.plans.fixtures import TABLES
from txmon.plans.registry import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    scols, srows = spark_rows(QUERIES[name](spark, SF_SMALL))
    ocols, orows = duck_rows(duck, ORACLE[name])
    assert sorted(scols) == sorted(ocols)
    assert canon(scols, srows) == canon(ocols, orows)


def test_entry_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["transaction_type", "n_transactions", "total_amount", "avg_amount",
                          "min_amount", "max_amount", "n_suspicious"]
