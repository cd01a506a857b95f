"""Queries of variable-length seeds, positions and the description of an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import search, seeds
from seqloom.plans.domain import SQL_ALL_GENES, SQL_CONTIGS, SQL_GENES, contigs, genes, over_all_genes
from seqloom.session import merge_join, table

LEAST = 21


def _unitigs(spark, sf_dir):
    u = table(spark, sf_dir, "unitigs").where(F.col("sequence").isNotNull() & (F.length("sequence") > 0))
    return u.groupBy("unitig_id").agg(F.max(F.upper("sequence")).alias("seq"))


def maximal_matches(spark, sf_dir):
    """Maximal exact matches between the contigs of genomes and the unitigs."""
    c = contigs(spark, sf_dir).select(F.concat_ws(":", "genome_id", "contig_no").alias("query_name"), "seq")
    return seeds.maximal_matches(c, _unitigs(spark, sf_dir), LEAST)


def longest_matches(spark, sf_dir, genes=genes):
    """Of every gene position: the longest stretch found in a contig's text, and in how many places."""
    targets = contigs(spark, sf_dir).select((F.col("genome_id") * 1000 + F.col("contig_no")).cast("int").alias("unitig_id"), "seq")
    out = seeds.longest_match(seeds.maximal_matches(genes(spark, sf_dir), targets, LEAST), LEAST)
    return out.groupBy("query_name").agg(F.count(F.lit(1)).alias("n_positions"), F.max("match_len").alias("longest"), F.sum("n_places").alias("places"))


def position_lookup(spark, sf_dir):
    """Every 97th position of the text of all unitigs."""
    starts = seeds.text_starts(_unitigs(spark, sf_dir))
    end = starts.agg(F.max(F.col("start") + F.col("len"))).first()[0] or 0
    return seeds.position_to_unitig(spark.range(0, end + 1, 97).select(F.col("id").alias("pos")), starts)


def position_lookup_all(spark, sf_dir):
    """Every position of the text of all unitigs, separators included."""
    starts = seeds.text_starts(_unitigs(spark, sf_dir))
    end = starts.agg(F.max(F.col("start") + F.col("len"))).first()[0]
    return seeds.position_to_unitig(spark.range(0, 0 if end is None else end + 1).select(F.col("id").alias("pos")), starts)


def index_info(spark, sf_dir):
    c = contigs(spark, sf_dir)
    u = _unitigs(spark, sf_dir).agg(F.count(F.lit(1)).alias("num_unitigs"), F.sum(F.length("seq")).alias("total_unitig_bases"))
    g = c.agg(F.count_distinct("genome_id").alias("num_genomes"), F.count(F.lit(1)).alias("num_contigs"), F.sum(F.length("seq")).alias("total_bases"))
    one = F.lit(1).alias("_k")  # one row each
    return g.select("*", one).join(u.select("*", one), "_k").drop("_k")


def kmer_set_overlap(spark, sf_dir, genes=genes):
    """Share of each gene's distinct words that the collection holds at all."""
    q = seeds.explode_kmers(genes(spark, sf_dir), ["query_name"], "seq", 31).select("query_name", "kmer").distinct()
    held = search.kmer_index(contigs(spark, sf_dir), 31).select("kmer").distinct().withColumn("_in", F.lit(1))
    out = merge_join(q, held, "kmer", "left").groupBy("query_name").agg(F.count(F.lit(1)).alias("n_words"), F.count("_in").alias("n_held"))
    return out.withColumn("share", F.round(F.col("n_held") / F.col("n_words"), 6))


QUERIES = {f.__name__: f for f in [maximal_matches, longest_matches, position_lookup, position_lookup_all, index_info, kmer_set_overlap]}

_U = "un AS (SELECT unitig_id, max(upper(sequence)) AS seq FROM unitigs WHERE sequence IS NOT NULL AND length(sequence) > 0 GROUP BY unitig_id)"


def _words(source: str, keys: str, k: int) -> str:
    return f"""SELECT {keys}, pos, least(g, rc) AS w, g > rc AS flip FROM (SELECT *, reverse(translate(g, 'ACGT', 'TGCA')) AS rc FROM (
  SELECT {keys}, pos, substr(seq, CAST(pos + 1 AS BIGINT), {k}) AS g FROM (SELECT {keys}, seq, unnest(range(greatest(length(seq) - {k - 1}, 0))) AS pos FROM {source})
  ) WHERE NOT regexp_matches(g, '[^ACGT]'))"""


def _runs(queries: str, targets: str) -> str:
    return f"""qw AS ({_words(queries, "query_name", LEAST)}), tw AS ({_words(targets, "unitig_id", LEAST)}),
tf AS (SELECT w FROM tw GROUP BY w HAVING count(*) <= 10000),
hits AS (SELECT query_name, unitig_id, q.pos AS qpos, t.pos AS tpos, q.flip <> t.flip AS is_reverse FROM qw q JOIN tw t USING (w) JOIN tf USING (w)),
dg AS (SELECT *, CASE WHEN is_reverse THEN tpos + qpos ELSE tpos - qpos END AS d FROM hits),
rn AS (SELECT *, qpos - row_number() OVER (PARTITION BY query_name, unitig_id, is_reverse, d ORDER BY qpos) AS run FROM dg),
mm AS (SELECT query_name, unitig_id, is_reverse, min(qpos) AS query_pos, min(tpos) AS unitig_offset, count(*) + {LEAST - 1} AS match_len FROM rn GROUP BY query_name, unitig_id, is_reverse, d, run)"""


SQL = {
    "maximal_matches": f"""WITH {SQL_CONTIGS}, {_U}, qs AS (SELECT genome_id || ':' || contig_no AS query_name, seq FROM ctg), {_runs("qs", "un")}
SELECT query_name, unitig_id, is_reverse, CAST(query_pos AS INTEGER) AS query_pos, CAST(unitig_offset AS INTEGER) AS unitig_offset, CAST(match_len AS INTEGER) AS match_len FROM mm""",
    "longest_matches": f"""WITH {SQL_CONTIGS}, {SQL_GENES}, ts AS (SELECT genome_id * 1000 + contig_no AS unitig_id, seq FROM ctg), {_runs("genes", "ts")},
a AS (SELECT query_name, p, query_pos + match_len - p AS l, count(*) AS n FROM (SELECT *, unnest(range(query_pos, query_pos + match_len - {LEAST} + 1)) AS p FROM mm) GROUP BY ALL),
b AS (SELECT query_name, p, max(l) AS l, max_by(n, l) AS n FROM a GROUP BY ALL)
SELECT query_name, count(*) AS n_positions, CAST(max(l) AS INTEGER) AS longest, CAST(sum(n) AS BIGINT) AS places FROM b GROUP BY query_name""",
    "position_lookup": f"""WITH {_U},
s AS (SELECT unitig_id, length(seq) AS n, sum(length(seq) + 1) OVER (ORDER BY unitig_id) - length(seq) - 1 AS start FROM un),
p AS (SELECT unnest(range(0, (SELECT max(start + n) + 1 FROM s)::BIGINT, 97)) AS pos)
SELECT pos, unitig_id, CAST(pos - start AS BIGINT) AS offset FROM p LEFT JOIN s ON pos >= start AND pos < start + n""",
    "position_lookup_all": f"""WITH {_U},
s AS (SELECT unitig_id, seq, length(seq) AS n, sum(length(seq) + 1) OVER (ORDER BY unitig_id) - length(seq) - 1 AS start FROM un)
SELECT CAST(start + o AS BIGINT) AS pos, CASE WHEN o < n THEN unitig_id END AS unitig_id, CASE WHEN o < n THEN CAST(o AS BIGINT) END AS offset
FROM (SELECT unitig_id, n, start, unnest(range(n + 1)) AS o FROM s)""",
    "index_info": f"""WITH {SQL_CONTIGS}, {_U}
SELECT (SELECT count(DISTINCT genome_id) FROM ctg) AS num_genomes, (SELECT count(*) FROM ctg) AS num_contigs, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM ctg) AS total_bases,
  (SELECT count(*) FROM un) AS num_unitigs, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM un) AS total_unitig_bases""",
    "kmer_set_overlap": f"""WITH {SQL_CONTIGS}, {SQL_GENES}, qw AS (SELECT DISTINCT query_name, w FROM ({_words("genes", "query_name", 31)})),
h AS (SELECT DISTINCT w FROM ({_words("ctg", "genome_id", 31)}))
SELECT query_name, count(*) AS n_words, count(h.w) AS n_held, round(count(h.w) / count(*), 6) AS share FROM qw LEFT JOIN h ON h.w = qw.w GROUP BY query_name""",
}

# over unitigs of any length; the SQL of the queries above is left as it is
ALL = [longest_matches, kmer_set_overlap]
QUERIES |= {f"{f.__name__}_all": over_all_genes(f) for f in ALL}
SQL |= {f"{f.__name__}_all": SQL[f.__name__].replace(SQL_GENES, SQL_ALL_GENES) for f in ALL if f.__name__ in SQL}
