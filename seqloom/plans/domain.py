"""Tables of the domain as the plans use them: contigs and query genes out of the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import search
from seqloom.session import table

GENE_LENGTH = 60  # unitigs from this length on serve as query genes


def contigs(spark, sf_dir):
    return search.contigs_of(table(spark, sf_dir, "sequences"))


def genes(spark, sf_dir):
    u = table(spark, sf_dir, "unitigs").where(F.col("sequence").isNotNull() & (F.length("sequence") >= GENE_LENGTH))
    one = u.groupBy("unitig_id").agg(F.max(F.upper("sequence")).alias("seq"))
    return one.select(F.concat(F.lit("u"), F.col("unitig_id").cast("string")).alias("query_name"), "seq")


def all_genes(spark, sf_dir):
    """Every unitig that has any letter, however short."""
    u = table(spark, sf_dir, "unitigs").where(F.col("sequence").isNotNull() & (F.length("sequence") > 0))
    one = u.groupBy("unitig_id").agg(F.max(F.upper("sequence")).alias("seq"))
    return one.select(F.concat(F.lit("u"), F.col("unitig_id").cast("string")).alias("query_name"), "seq")


SQL_CONTIGS = """
ctg0 AS (
  SELECT seq_id, max((length(seq), upper(seq), genome_id, contig_name)) AS m FROM sequences
  WHERE seq IS NOT NULL AND length(seq) > 0 AND genome_id IS NOT NULL GROUP BY seq_id
), ctg AS (
  SELECT seq_id, struct_extract_at(m, 3) AS genome_id, struct_extract_at(m, 2) AS seq,
    row_number() OVER (PARTITION BY struct_extract_at(m, 3) ORDER BY seq_id) - 1 AS contig_no,
    sum(struct_extract_at(m, 1)) OVER (PARTITION BY struct_extract_at(m, 3) ORDER BY seq_id) - struct_extract_at(m, 1) AS base_offset
  FROM ctg0
)"""

SQL_GENES = f"""
genes AS (
  SELECT 'u' || unitig_id AS query_name, max(upper(sequence)) AS seq FROM unitigs
  WHERE sequence IS NOT NULL AND length(sequence) >= {GENE_LENGTH} GROUP BY unitig_id
)"""


SQL_ALL_GENES = """
genes AS (
  SELECT 'u' || unitig_id AS query_name, max(upper(sequence)) AS seq FROM unitigs
  WHERE sequence IS NOT NULL AND length(sequence) > 0 GROUP BY unitig_id
)"""


def over_all_genes(query):
    """The same query over ``all_genes``, named with ``_all``."""

    def run(spark, sf_dir):
        return query(spark, sf_dir, all_genes)

    run.__name__, run.__doc__ = f"{query.__name__}_all", query.__doc__
    return run


def sql_kmers(k: int, source: str, keys: str) -> str:
    """Clean windows of ``source`` (keys..., seq) with canonical text ``w`` (the lesser of both strands)."""
    return f"""
SELECT {keys}, pos, least(g, reverse(translate(g, 'ACGT', 'TGCA'))) AS w FROM (
  SELECT {keys}, pos, substr(seq, CAST(pos + 1 AS BIGINT), {k}) AS g
  FROM (SELECT {keys}, seq, unnest(range(greatest(length(seq) - {k} + 1, 0))) AS pos FROM {source}))
WHERE NOT regexp_matches(g, '[^ACGT]')"""
