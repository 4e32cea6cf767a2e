"""Every registered query against its SQL on the smallest tables, and invariance of results."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, connect, rows_of

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, sf_dir, name):
    verdict, rows, _ = compare(spark, connection, QUERIES[name], ORACLES.get(name), sf_dir)
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["asof_last_within_hold", "prior_history", "portfolio_grid", "closed_portfolio"])
def test_results_do_not_depend_on_shuffle_width(spark, sf_dir, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            df = QUERIES[name](spark, sf_dir)
            seen.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
