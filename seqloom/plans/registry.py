"""Named queries of the core with their SQL counterparts, gathered from the modules of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.plans import aligning, reporting, searching, seeding, signal_loading, signalling

FLAGSHIP = "prevalence"
MODULES = [signal_loading, searching, signalling, reporting, aligning, seeding]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for m in MODULES for name, sql in m.SQL.items()}
    return out | {"index_growth": out["shard_merge"], "index_growth_all": out["shard_merge_all"]}  # the same two shards, stored
