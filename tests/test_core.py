import pytest

from tessera.plans import ORACLES, QUERIES
from tessera.sources import table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLES[name])


def test_unknown_table(spark, sf_dir):
    with pytest.raises(ValueError):
        table(spark, sf_dir, "nothing")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
