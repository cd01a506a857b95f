"""Text renderings of results as one-column frames (``value``) and their writers.

Numbers stay typed in the frames; only here they become text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import cigar, stats
from seqloom.sources.paf import COLUMNS as PAF_COLUMNS


def _line(*cols: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])


def paf_lines(records: DataFrame) -> DataFrame:
    tags = F.filter("tags", lambda t: t.isNotNull()) if "tags" in records.columns else F.array().cast("array<string>")
    tail = F.when(F.size(tags) > 0, F.concat(F.lit("\t"), F.array_join(tags, "\t"))).otherwise(F.lit(""))
    return records.select(F.concat(_line(*PAF_COLUMNS), tail).alias("value"))


def blast_columns(records: DataFrame, database_len: int) -> DataFrame:
    """Typed tabular columns: from the CIGAR where a ``cg`` tag stands, else from NM or lengths; subject
    coordinates are 1-based and ascending on either strand."""
    s = F.col("_s")
    nm = F.expr("try_cast(_nm AS int)")
    mismatches = F.coalesce(s["mismatches"], nm, F.greatest(F.col("alignment_len") - F.col("num_matches"), F.lit(0)))
    length = F.coalesce(s["aln_len"], F.greatest(F.col("query_end") - F.col("query_start"), F.col("num_matches")))
    identity = F.when(F.col("query_len") > 0, F.col("num_matches") / F.col("query_len")).otherwise(F.lit(0.0))
    rows = records.withColumn("_cg", cigar.tag("tags", "cg")).withColumn("_nm", cigar.tag("tags", "NM"))
    rows = rows.withColumn("_s", cigar.trimmed_statistics(F.when(F.col("_cg") != "", F.col("_cg"))))
    return rows.select(
        F.col("query_name").alias("qseqid"),
        F.col("target_name").alias("sseqid"),
        F.when(length > 0, F.least(F.col("num_matches") / length * 100, F.lit(100.0))).otherwise(identity * 100).alias("pident"),
        length.cast("int").alias("length"),
        mismatches.cast("int").alias("mismatch"),
        F.coalesce(s["gap_opens"], F.lit(0)).alias("gapopen"),
        (F.col("query_start") + 1).alias("qstart"),
        F.col("query_end").alias("qend"),
        (F.col("target_start") + 1).alias("sstart"),
        F.col("target_end").alias("send"),
        stats.e_value("num_matches", mismatches, "query_len", float(database_len)).alias("evalue"),
        stats.bit_score("num_matches", mismatches).alias("bitscore"),
    )


def blast_lines(records: DataFrame, database_len: int) -> DataFrame:
    b = blast_columns(records, database_len)
    return b.select(
        F.format_string(
            "%s\t%s\t%.3f\t%d\t%d\t%d\t%d\t%d\t%d\t%d\t%.2e\t%.1f",
            *[F.col(c) for c in ("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")],
        ).alias("value")
    )


BLAST_HEADER = (
    "# Fields: query id\tsubject id\t% identity\talignment length\tmismatches\tgap opens\tq. start\tq. end\ts. start\ts. end\tevalue\tbit score"
)
SUMMARY_HEADER = "#query\tspecies\thit_count\tgenome_count\tprevalence\tmean_identity\tmin_identity\tmax_identity\tunique_variants"


def summary_lines(summary: DataFrame) -> DataFrame:
    f = F.format_string(
        "%s\t%s\t%d\t%d\t%.6f\t%.4f\t%.4f\t%.4f\t%d",
        *[F.col(c) for c in ("query_name", "species", "hit_count", "genome_count", "prevalence", "mean_identity", "min_identity", "max_identity", "unique_variants")],
    )
    return summary.select(f.alias("value"))


def surveillance_lines(per_query: DataFrame) -> DataFrame:
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    f = F.format_string(
        "%s\t%d\t%s\t%d\t%d\t%.6f\t%.4f\t%.4f\t%.4f\t%.4f\t%.4f\t%d",
        F.col("query_name"), F.col("query_len"), F.col("species"), none("hit_count"), none("genome_count"),
        *[none(c).cast("double") for c in ("prevalence", "mean_identity", "median_identity", "stdev_identity", "min_identity", "max_identity")],
        none("unique_variants"),
    )
    zero = _line("query_name", "query_len", "species", *[F.lit("0")] * 9)
    return per_query.select(F.when(F.col("species") == "NO_HITS", zero).otherwise(f).alias("value"))


def prevalence_lines(rows: DataFrame) -> DataFrame:
    cols = ("query_name", "query_len", "kmers_hit", "best_genome", "best_shared")
    return rows.select(
        F.concat_ws("\t", _line(*cols), F.format_string("%.4f", "containment"), _line("genomes_at_best", "genomes_hit")).alias("value")
    )


def signal_lines(reads: DataFrame) -> DataFrame:
    """``read_id<TAB>v1<TAB>...`` with two decimals."""
    return reads.select(
        F.concat_ws("\t", F.col("read_id"), F.array_join(F.transform("signal", lambda x: F.format_string("%.2f", x.cast("double"))), "\t")).alias("value")
    )


def gfa_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """H, S and L lines; nodes (subgraph, unitig_id, seq, genome_ids, is_hit, information_content,
    is_private), edges (subgraph, from_unitig, from_orient, to_unitig, to_orient)."""
    colors = F.array_join(F.transform("genome_ids", lambda g: g.cast("string")), ",")
    length = F.length("seq").cast("string")
    s = nodes.select(
        "subgraph",
        F.lit(1).alias("part"),
        F.col("unitig_id").cast("long").alias("a"),
        F.lit(0).cast("long").alias("b"),
        F.concat_ws(
            "\t", F.lit("S"), F.concat(F.lit("u"), F.col("unitig_id").cast("string")), F.coalesce("seq", F.lit("*")),
            F.concat(F.lit("LN:i:"), F.coalesce(length, F.lit("0"))), F.concat(F.lit("RC:i:"), F.size("genome_ids").cast("string")),
            F.concat(F.lit("CL:Z:"), F.when(F.col("is_hit"), "red").otherwise("gray")),
            F.concat(F.lit("TP:Z:"), F.when(F.col("is_hit"), "hit").otherwise("context")),
            F.concat(F.lit("IC:f:"), F.format_string("%.2f", F.col("information_content"))),
            F.concat(F.lit("PV:i:"), F.col("is_private").cast("int").cast("string")), F.concat(F.lit("CO:Z:"), colors),
        ).alias("value"),
    )
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    e = edges.select(
        "subgraph", F.lit(2).alias("part"), F.col("from_unitig").cast("long").alias("a"), F.col("to_unitig").cast("long").alias("b"),
        F.concat_ws("\t", F.lit("L"), u("from_unitig"), "from_orient", u("to_unitig"), "to_orient", F.lit("0M")).alias("value"),
    )
    h = nodes.select("subgraph").distinct().select(
        "subgraph", F.lit(0).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit("H\tVN:Z:1.0").alias("value")
    )
    return h.unionByName(s).unionByName(e)


def color_lines(colors: DataFrame) -> DataFrame:
    """``unitig<TAB>g1,g2,...``"""
    return colors.groupBy("unitig_id").agg(F.sort_array(F.collect_set("genome_id")).alias("g")).select(
        F.concat_ws("\t", F.col("unitig_id").cast("string"), F.array_join(F.transform("g", lambda x: x.cast("string")), ",")).alias("value")
    )


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Text files, spread over tasks; the header in a file of its own that sorts first."""
    lines.select("value").write.mode("overwrite").text(path)
    if header is not None:
        lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".header")
