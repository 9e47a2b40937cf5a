"""Every registered query runs on the smallest tables and equals its SQL."""

import check_oracle
import pytest

import __spark_entry__ as entry

from conftest import SMALL

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    status, rows, _, diff = check_oracle.compare(spark, con, entry.queries()[name], sql, SMALL)
    assert status == ("ok" if sql else "rows"), diff
    assert rows > 0 or name in MAY_BE_EMPTY
    assert not [d for d in diff if d[0] == "types"], diff


# Too few rows at this scale to find anything.
MAY_BE_EMPTY = {"s08_interval_join", "s09_paired_sessions", "s17_rate_limit", "a48_quarantine"}


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["verdict", "lang", "docs"] and df.count() > 0
