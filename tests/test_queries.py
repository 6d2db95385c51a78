"""Every registered query against its SQL, on the smallest tables."""

import pytest

from cadenza.plans import registry

from . import oracle

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf, name):
    oracle.check(spark, sf, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.count() >= 0


def test_entry():
    import __spark_entry__

    assert callable(__spark_entry__.entry) and "n19_sessionize" in __spark_entry__.queries()
