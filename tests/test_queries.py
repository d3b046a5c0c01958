"""Every query that SQL can express gives the rows that DuckDB gives; the others run and repeat themselves."""

import compare
import pytest

from loam.plans.all import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, small, name):
    assert compare.differences(spark, con, QUERIES[name], ORACLE[name], small) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_repeats_itself(spark, small, name):
    first, second = ([tuple(map(str, r)) for r in QUERIES[name](spark, small).collect()] for _ in range(2))
    assert sorted(first) == sorted(second)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
