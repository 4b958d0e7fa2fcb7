"""Every query of the library against its SQL in DuckDB; those without SQL against properties below."""

import pytest
from support import SF, same_rows

from helixlake.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_with_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_stands_without_llm(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
