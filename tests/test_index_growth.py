from seqloom.operators import index_store
from seqloom.plans import registry
from tests.oracle import same


def test_index_growth_compacts(spark, data, monkeypatch):
    grown, compact = [], index_store.compact

    def seen(s, folder, *rest):
        grown.append(index_store.shards(s, folder))
        compact(s, folder, *rest)

    monkeypatch.setattr(index_store, "compact", seen)
    folder = f"{data}/."  # of another name, so that nothing built before is used again
    assert same(spark, folder, registry.queries()["index_growth"], registry.oracle_sql()["index_growth"])
    assert grown == [[0, 1], [0, 1]]
