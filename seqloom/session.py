"""Session helpers: checkpoint folder, table access, skew-safe joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in
    ``spark.checkpoint.dir``.  Only where that is unset (tests, one machine)
    a local temporary folder is used."""
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="seqloom-ckpt-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage with files in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join by sort and merge, never by broadcast: of rows exploded out of texts or lists the planner guesses
    the size from the texts', which is many times too small, and the table outgrows the driver."""
    return left.join(right.hint("merge"), on, how)


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    salt_by: Column,
    salts: int = 8,
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` to a table with one row per ``on``, for keys of which one
    may hold a large share of the facts.

    The lookup side is repeated ``salts`` times (it has one row per key, so it
    is the smaller side), the facts are spread by ``salt_by``: the hottest key
    goes to ``salts`` tasks.  AQE still splits what stays skewed, and still
    broadcasts the lookup where its measured size allows.
    """
    wide = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        facts.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
        .join(wide, [on, "_salt"], how)
        .drop("_salt")
    )
