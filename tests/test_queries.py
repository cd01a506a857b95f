import pytest

from seqloom.plans import registry
from tests.oracle import same

SQL = registry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
    assert registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, registry.queries()[name], SQL[name])


@pytest.mark.parametrize(
    "name", ["aligned_hits", "aligned_hits_graph", "best_chains", "signal_events", "signal_genomes", "hit_gfa", "containment_adaptive", "surveillance_json"]
)
def test_query_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).columns
    registry.queries()[name](spark, data).limit(5).collect()
