"""Usable alignment records: validity and exact copies, in one shuffle.

A record is usable if query_name, num_matches and alignment_len are not null,
alignment_len > 0 and 0 <= num_matches <= alignment_len.  Rows that agree in
every column but ``rec_id`` and ``loaded_at`` are one record, kept under the
smallest ``rec_id`` (null ids count as larger than all others).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.names import species_of

CONTENT = [
    "query_name", "query_len", "query_start", "query_end", "strand", "target_name", "target_len",
    "target_start", "target_end", "num_matches", "alignment_len", "mapq", "tags", "run_day",
]


def content_key() -> list[Column]:
    """128 bits that tell records apart.  Nulls are written out, as Spark's hashes skip them; two
    different seeds make the two halves independent."""
    shown = [
        F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c != "tags" else F.coalesce(F.to_json(c), F.lit("\x00"))
        for c in CONTENT
    ]
    line = F.concat_ws("\x01", *shown)
    return [F.xxhash64(F.lit(17), line).alias("_key_a"), F.xxhash64(line, F.lit(40961)).alias("_key_b")]


def usable_records(paf: DataFrame) -> DataFrame:
    """Distinct usable records with species and identity.  Copies are combined before the shuffle, which
    goes by the content, so rows are spread evenly whatever group they belong to."""
    ok = (
        F.col("query_name").isNotNull()
        & F.col("num_matches").isNotNull()
        & (F.col("alignment_len") > 0)
        & (F.col("num_matches") >= 0)
        & (F.col("num_matches") <= F.col("alignment_len"))
    )
    # beside the key, what is kept follows from the content
    kept = ["query_name", "species", "run_day", "num_matches", "alignment_len"]
    rows = paf.where(ok).withColumn("species", species_of("target_name")).select("rec_id", *kept, *content_key())
    one = rows.groupBy(*kept, "_key_a", "_key_b").agg(F.min("rec_id").alias("rec_id"))
    return one.select("rec_id", *kept, (F.col("num_matches") / F.col("alignment_len")).alias("identity"))
