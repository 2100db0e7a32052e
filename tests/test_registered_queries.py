"""Every registered query of the core runs, and equals its SQL where it has one."""

import pytest
from oracle import assert_same, connect

import quernlake.plans.more_queries  # noqa: F401
import quernlake.plans.text_queries  # noqa: F401
from quernlake.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert_same(df, con, ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
