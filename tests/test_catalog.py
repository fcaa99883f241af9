"""Every registered query against its DuckDB oracle on the sf0.001 tables,
plus the driver contract of __spark_entry__."""

import pytest

import __spark_entry__ as E
from lensmap.plans.oracle import check, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    df = E.entry(spark)
    assert df.columns == ["fb_id", "rank", "id", "score", "insight", "aspect"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    c = check(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    if c.match is None:
        assert c.rows >= 0
    else:
        assert c.same_columns and c.match, c.detail
        assert c.rows == c.oracle_rows
