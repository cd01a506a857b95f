"""Joins of exploded words are never broadcast, however small the planner takes them for."""

import re

import pytest

from seqloom.plans import registry, reporting
from seqloom.plans.domain import contigs

ALLOWED = {"index_growth": {"shard_id"}}  # one row a shard
NAMES = [
    "aligned_hits", "aligned_hits_graph", "best_chains", "containment_adaptive", "containment_pigeonhole", "hit_gfa", "index_growth", "kmer_set_overlap",
    "longest_matches", "maximal_matches", "prevalence", "seed_features", "sprt_decisions",
]


@pytest.fixture
def generous(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def broadcast_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan)) | set(re.findall(r"BroadcastNestedLoopJoin", plan))


@pytest.mark.parametrize("name", NAMES)
def test_words_are_not_broadcast(generous, data, name):
    assert broadcast_keys(registry.queries()[name](generous, data)) <= ALLOWED.get(name, set())


def test_ends_of_words_are_not_broadcast(generous, data):
    assert not broadcast_keys(reporting.graph_ends(contigs(generous, data), 31))


def test_signal_words_are_not_broadcast(generous, data):
    assert not broadcast_keys(registry.queries()["signal_genomes"](generous, data)) & {"word", "read_id"}
