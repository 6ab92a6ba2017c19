"""Every query of the library against its SQL, over whole tables."""

import pytest

from orthoscan import registry
from tests.conftest import same_rows

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.oracle_sql()])
def test_query_matches_sql(spark, sf, duck, name):
    same_rows(registry.queries()[name](spark, sf), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.oracle_sql()])
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_and_optional_part(spark, sf):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
