import pytest

from seqloom.llm import queries as llm
from tests.oracle import same

SQL = llm.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(llm.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, llm.queries()[name], SQL[name])


def test_classes_and_links_agree_with_pairs(spark, data):
    pairs = llm.queries()["p3_found"](spark, data).collect()
    links = {}
    for r in pairs:
        for x in ("id_a", "id_b"):
            links[r["kind"], r[x]] = links.get((r["kind"], r[x]), 0) + 1
    for r in llm.queries()["p3_classes"](spark, data).collect():
        assert r["n_links"] == links.get((r["kind"], r["id"]), 0)


@pytest.mark.parametrize("name", ["p4_species", "p4_periods"])
def test_percentiles_are_certified(spark, data, name):
    rows = llm.queries()[name](spark, data).collect()
    assert rows and max((r["rank_error"] for r in rows if r["n"] >= 200), default=0) < 0.02
    assert {r["quantile"] for r in rows} == {0.05, 0.25, 0.5, 0.75, 0.95}
