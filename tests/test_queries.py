"""Every registered query against its SQL on the small tables, and whole-table brute force where there is none."""
import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    text, _, ok = compare(spark, con, sf_dir, name)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)
