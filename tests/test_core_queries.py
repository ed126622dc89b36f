import pytest
from oracle import compare

from quillsieve.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, sf, name):
    compare(spark, sf, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert registry.FLAGSHIP(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["hidden_instructions", "disguised_instructions"])
def test_instructions_where_texts_are_disguised(spark, name):
    """What only shows without disguises is no row of the one and the rows of the other."""
    assert compare(spark, "/root/testdata/sf0.01", registry.QUERIES[name], registry.SQL[name]) > 0
