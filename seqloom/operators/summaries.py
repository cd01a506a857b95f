"""Reports over alignment records: species summaries and the two-level surveillance rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.names import species_of


def with_identity(records: DataFrame) -> DataFrame:
    """``identity`` is num_matches / query_len, 0 without a length."""
    return records.withColumn("identity", F.when(F.col("query_len") > 0, F.col("num_matches") / F.col("query_len")).otherwise(F.lit(0.0)))


def species_summary(records: DataFrame, total_genomes: int, by: list[str] | None = None) -> DataFrame:
    """Per species (and ``by``): hits, genomes, prevalence, mean, exact median, sample deviation (0 for
    one), extremes and distinct truncated thousandths of identity."""
    rows = with_identity(records.where(F.col("target_name").isNotNull())).withColumn("species", species_of("target_name", True))
    prevalence = F.count_distinct("target_name") / F.lit(float(total_genomes)) if total_genomes > 0 else F.lit(0.0)
    return rows.groupBy(*(by or []), "species").agg(
        F.count(F.lit(1)).alias("hit_count"),
        F.count_distinct("target_name").alias("genome_count"),
        prevalence.alias("prevalence"),
        F.avg("identity").alias("mean_identity"),
        F.median("identity").alias("median_identity"),
        F.coalesce(F.stddev_samp("identity"), F.lit(0.0)).alias("stdev_identity"),
        F.min("identity").alias("min_identity"),
        F.max("identity").alias("max_identity"),
        F.count_distinct(F.floor(F.col("identity") * 1000)).alias("unique_variants"),
    )


def aggregate_species(per_query: DataFrame, total_genomes: int) -> DataFrame:
    """Rollup of summaries by query and species: a mean of means, and a prevalence that may exceed 1 as
    genomes are summed over queries."""
    prevalence = F.sum("genome_count") / F.lit(float(total_genomes)) if total_genomes > 0 else F.lit(0.0)
    return per_query.groupBy("species").agg(
        F.count(F.lit(1)).alias("queries_with_hits"),
        F.sum("hit_count").alias("total_hits"),
        F.sum("genome_count").alias("total_genomes"),
        F.avg("mean_identity").alias("mean_identity_across_queries"),
        prevalence.alias("prevalence"),
    )


def surveillance(records: DataFrame, queries: DataFrame, total_genomes: int) -> tuple[DataFrame, DataFrame]:
    """(per query and species with NO_HITS rows, per species); ``queries`` (query_name, query_len)."""
    per = species_summary(records, total_genomes, ["query_name"])
    return queries.join(per, "query_name", "left").withColumn("species", F.coalesce("species", F.lit("NO_HITS"))), aggregate_species(
        per, total_genomes
    )


def surveillance_json(records: DataFrame, queries: DataFrame, total_genomes: int) -> DataFrame:
    """One JSON text per query, species nested by hits with their genomes' identities."""
    per = species_summary(records, total_genomes, ["query_name"])
    rows = with_identity(records.where(F.col("target_name").isNotNull())).withColumn("species", species_of("target_name", True))
    genomes = rows.groupBy("query_name", "species").agg(
        F.sort_array(F.collect_list(F.struct(F.col("target_name").alias("name"), F.col("identity").alias("ani")))).alias("genomes")
    )
    full = per.join(genomes, ["query_name", "species"])
    nested = full.groupBy("query_name").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (-F.col("hit_count")).alias("order"), "species", "hit_count", "genome_count", "prevalence", "mean_identity",
                    "median_identity", "stdev_identity", "min_identity", "max_identity", "unique_variants", "genomes",
                )
            )
        ).alias("species"),
        F.sum("hit_count").alias("total_hits"),
    )
    drop = F.transform("species", lambda s: s.dropFields("order"))
    return queries.join(nested, "query_name", "left").select(
        "query_name",
        F.to_json(
            F.struct("query_name", "query_len", F.coalesce("total_hits", F.lit(0)).alias("total_hits"), drop.alias("species"))
        ).alias("json"),
    )
