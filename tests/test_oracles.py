"""Every registered query with checking SQL, on the smallest supplied tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from tools.compare import DATA, connection, rows_of, types_of  # noqa: E402

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    mine = contract.queries()[name](spark, f"{DATA}/{SF}").toArrow()
    theirs = con.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert types_of(mine) == types_of(theirs)
    assert rows_of(mine) == rows_of(theirs)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
