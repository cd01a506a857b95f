"""Queries of the search path: k-mers, containment, ranking, prevalence, candidates, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.config import SearchConfig
from seqloom.functions import dna, stats
from seqloom.operators import search
from seqloom.plans.domain import SQL_ALL_GENES, SQL_CONTIGS, SQL_GENES, contigs, genes, over_all_genes, sql_kmers
from seqloom.session import table

K = 31


def kmer_frequency(spark, sf_dir):
    """How many k-mers occur how often and in how many genomes."""
    rows = search.kmer_frequency(search.kmer_index(contigs(spark, sf_dir), K))
    return rows.groupBy("freq", "card").agg(F.count(F.lit(1)).alias("n_kmers"))


def genome_kmers(spark, sf_dir):
    idx = search.kmer_index(contigs(spark, sf_dir), K)
    return idx.groupBy("genome_id").agg(
        F.count(F.lit(1)).alias("n_kmers"), F.count_distinct("kmer").alias("n_distinct"), F.max("pos").alias("last_pos")
    )


def canonical_kmers(spark, sf_dir):
    """Packed canonical words of short k-mers, by word."""
    idx = search.kmer_index(contigs(spark, sf_dir), 7)
    return idx.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_rc").alias("n_rc"))


def sequence_functions(spark, sf_dir):
    s = contigs(spark, sf_dir)
    head = F.substring("seq", 1, 9)
    return s.select(
        "genome_id",
        "contig_no",
        F.round(dna.gc_content("seq"), 9).alias("gc"),
        dna.reverse_complement(head).alias("rc"),
        dna.reverse_complement(head, True).alias("rc_n"),
        dna.kmer_to_index(head).alias("idx"),
        dna.index_to_kmer(dna.kmer_to_index(head), 9).alias("back"),
        dna.is_unambiguous("seq").alias("unambiguous"),
        dna.subsequence("seq", F.lit(3), F.lit(11)).alias("part"),
    )


def reverse_complements(spark, sf_dir):
    """Both forms of the reverse complement of every whole contig, by checksum."""
    return contigs(spark, sf_dir).select(
        "genome_id", "contig_no", F.length("seq").alias("n"), F.md5(dna.reverse_complement("seq")).alias("rc"), F.md5(dna.reverse_complement("seq", True)).alias("rc_n")
    )


def adaptive_k_choice(spark, sf_dir):
    g = genes(spark, sf_dir).withColumn("n", F.length("seq"))
    return g.select(
        "query_name", stats.adaptive_k("n").cast("int").alias("k"), stats.adaptive_k_cross_species("n").cast("int").alias("k_cross")
    )


def sampled_query_kmers(spark, sf_dir):
    rows = dna.sampled_kmers(genes(spark, sf_dir), ["query_name"], "seq", K, 100)
    return rows.groupBy("query_name", "n_sampled").agg(
        F.count(F.lit(1)).alias("n_clean"), F.sum("pos").alias("pos_sum"), F.count_distinct("kmer").alias("n_distinct")
    )


def containment_rank(spark, sf_dir, genes=genes):
    """Candidates of every gene with all their scores."""
    out = search.containment(genes(spark, sf_dir), contigs(spark, sf_dir), SearchConfig(kmer_size=K))
    return out.select(
        "query_name", "genome_id", "n_sampled", "shared", "rank",
        *[F.round(c, 6).alias(c) for c in ("containment", "info_score", "bayes_prob", "bayes_prob_hc", "bayes_ani", "ani_ci")],
    )


def containment_pigeonhole(spark, sf_dir, genes=genes):
    """The same with the anchor fallback of queries that have few whole words in the collection."""
    out = search.containment(genes(spark, sf_dir), contigs(spark, sf_dir), SearchConfig(kmer_size=K, pigeonhole=True))
    return out.select("query_name", "genome_id", "n_sampled", "shared", "solid", "rank", F.round("info_score", 6).alias("info_score"))


def containment_chunked(spark, sf_dir, genes=genes):
    """The same with the scores of the chunked store: 500 samples, natural logarithm."""
    c = SearchConfig(kmer_size=K, sample_target=500, ic_mode="position_max_ln")
    return search.containment(genes(spark, sf_dir), contigs(spark, sf_dir), c).select(
        "query_name", "genome_id", "shared", F.round("info_score", 6).alias("info_score")
    )


def containment_adaptive(spark, sf_dir, genes=genes):
    """Every gene at the k of its length, then at smaller ones."""
    out = search.adaptive_containment(genes(spark, sf_dir), contigs(spark, sf_dir))
    return out.select("query_name", "genome_id", "k", "shared", F.round("info_score", 6).alias("info_score"))


def top_genomes(spark, sf_dir, genes=genes):
    out = search.containment(genes(spark, sf_dir), contigs(spark, sf_dir), SearchConfig(kmer_size=K, max_candidates=5))
    return search.mapping_quality(out).select("query_name", "genome_id", "rank", "shared", "mapq")


def prevalence(spark, sf_dir, genes=genes):
    """For every gene: the best genome, and how many genomes hold as much or anything of it."""
    out = search.prevalence(genes(spark, sf_dir), contigs(spark, sf_dir), K)
    return out.select("*").withColumn("containment", F.round("containment", 6))


def sprt_decisions(spark, sf_dir, genes=genes):
    samples, hits = search.sampled_hits(genes(spark, sf_dir), contigs(spark, sf_dir), K)
    return search.sprt_trace(samples, hits).select("query_name", "decision", "decided_at", F.round("llr", 6).alias("llr"))


def _colors(spark, sf_dir):
    return (
        table(spark, sf_dir, "subgraph_nodes").where(F.col("unitig_id").isNotNull())
        .select("unitig_id", F.explode("genome_ids").alias("genome_id")).where(F.col("genome_id").isNotNull()).distinct()
    )


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "subgraph_nodes").where(F.col("query_name").isNotNull() & F.col("unitig_id").isNotNull()).select(
        "query_name", "unitig_id"
    )


def candidate_votes(spark, sf_dir):
    c = _colors(spark, sf_dir)
    n = c.agg(F.count_distinct("genome_id")).first()[0]
    return search.candidate_votes(_seeds(spark, sf_dir), c, n, 2).select(
        "query_name", "genome_id", "vote_count", F.round("vote_score", 6).alias("vote_score")
    )


def greedy_candidates(spark, sf_dir):
    return search.greedy_candidates(_seeds(spark, sf_dir), _colors(spark, sf_dir), 40)


def shard_merge(spark, sf_dir, genes=genes):
    """Two shards with their own collection sizes, ranked together."""
    c = contigs(spark, sf_dir).withColumn("shard_id", F.col("genome_id") % 2)
    out = search.sharded_containment(genes(spark, sf_dir), c, SearchConfig(kmer_size=K))
    return out.select("query_name", "genome_id", "shard_id", "shared", "rank", F.round("info_score", 6).alias("info_score"))


QUERIES = {
    f.__name__: f
    for f in [
        kmer_frequency, genome_kmers, canonical_kmers, sequence_functions, reverse_complements, adaptive_k_choice, sampled_query_kmers, containment_rank,
        containment_pigeonhole, containment_chunked, containment_adaptive, top_genomes, prevalence, sprt_decisions, candidate_votes, greedy_candidates, shard_merge,
    ]
}


def _hits(target: int, k: int = K) -> str:
    return f"""WITH {SQL_CONTIGS}, {SQL_GENES},
idx AS ({sql_kmers(k, "ctg", "genome_id, base_offset")}),
kg AS (SELECT w, genome_id, count(*) AS n FROM idx GROUP BY ALL),
freq AS (SELECT w, sum(n) AS freq, count(*) AS card FROM kg GROUP BY w),
sized AS (SELECT *, length(seq) - {k} + 1 AS total, greatest(floor((length(seq) - {k} + 1) / {target}), 1) AS stride FROM genes WHERE length(seq) >= {k}),
smp AS (SELECT query_name, CAST(floor((total - 1) / stride) + 1 AS INTEGER) AS n_sampled, pos, w
  FROM ({sql_kmers(k, "sized", "query_name, total, stride")}) WHERE pos % stride = 0),
hits AS (SELECT s.query_name, s.n_sampled, s.pos, s.w, kg.genome_id, f.card FROM smp s JOIN freq f USING (w) JOIN kg USING (w) WHERE f.freq <= 10000),
n AS (SELECT count(DISTINCT genome_id) AS n FROM ctg)"""


_CDF = """CASE WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END"""


def _prob(theta: float) -> str:
    mu, m = "(shared + 1.0) / (n_sampled + 2.0)", "(n_sampled + 2.0)"
    z = f"(({mu} - {theta}) / sqrt({mu} * (1 - {mu}) / {m}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * abs({z})))"
    p = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    e = f"(1 - {p} * exp(-{z} * {z}))"
    return f"least(greatest(CASE WHEN {z} >= 0 THEN (1 + {e}) / 2 ELSE (1 - {e}) / 2 END, 0), 1)"


_SCORED = f"""{_hits(384)},
sc AS (SELECT query_name, genome_id, n_sampled, count(*) AS shared, sum(log2((SELECT n FROM n) / card)) AS info FROM hits GROUP BY ALL),
pr AS (SELECT *, shared / n_sampled AS c, CAST({_prob(0.5)} AS DOUBLE) AS bp, CAST({_prob(0.9)} AS DOUBLE) AS bq,
  CAST(pow((shared + 1.0) / (n_sampled + 2.0), 1.0 / {K}) AS DOUBLE) AS ba FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY round(info, 9) DESC, round(bp, 9) DESC, genome_id) AS rank FROM pr)"""

_COLORS = """colors AS (SELECT DISTINCT unitig_id, genome_id FROM (SELECT unitig_id, unnest(genome_ids) AS genome_id FROM subgraph_nodes)
  WHERE unitig_id IS NOT NULL AND genome_id IS NOT NULL),
card AS (SELECT unitig_id, count(*) AS card FROM colors GROUP BY unitig_id),
seeds AS (SELECT DISTINCT query_name, unitig_id FROM subgraph_nodes WHERE query_name IS NOT NULL AND unitig_id IS NOT NULL)"""

SQL = {
    "kmer_frequency": f"""WITH {SQL_CONTIGS}, idx AS ({sql_kmers(K, "ctg", "genome_id, base_offset")}),
f AS (SELECT w, count(*) AS freq, count(DISTINCT genome_id) AS card FROM idx GROUP BY w)
SELECT freq, card, count(*) AS n_kmers FROM f GROUP BY ALL""",
    "genome_kmers": f"""WITH {SQL_CONTIGS}, idx AS ({sql_kmers(K, "ctg", "genome_id, base_offset")})
SELECT genome_id, count(*) AS n_kmers, count(DISTINCT w) AS n_distinct, CAST(max(base_offset + pos) AS BIGINT) AS last_pos FROM idx GROUP BY genome_id""",
    "canonical_kmers": f"""WITH {SQL_CONTIGS}, g AS (
  SELECT substr(seq, CAST(pos + 1 AS BIGINT), 7) AS g FROM (SELECT seq, unnest(range(greatest(length(seq) - 6, 0))) AS pos FROM ctg)
), c AS (SELECT g, count(*) AS n FROM g WHERE NOT regexp_matches(g, '[^ACGT]') GROUP BY g),
p AS (SELECT n, CAST(list_sum(list_transform(range(7), lambda i: (strpos('ACGT', g[i + 1]) - 1) * CAST(pow(4, i) AS BIGINT))) AS BIGINT) AS f,
  CAST(list_sum(list_transform(range(7), lambda i: (strpos('TGCA', g[7 - i]) - 1) * CAST(pow(4, i) AS BIGINT))) AS BIGINT) AS r FROM c)
SELECT least(f, r) AS kmer, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN r < f THEN n ELSE 0 END) AS BIGINT) AS n_rc FROM p GROUP BY 1""",
    "sequence_functions": f"""WITH {SQL_CONTIGS}
SELECT genome_id, CAST(contig_no AS INTEGER) AS contig_no, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 9) AS gc,
  translate(reverse(substr(seq, 1, 9)), 'ACGT', 'TGCA') AS rc,
  regexp_replace(translate(reverse(substr(seq, 1, 9)), 'ACGT', 'TGCA'), '[^ACGT]', 'N', 'g') AS rc_n,
  CASE WHEN NOT regexp_matches(substr(seq, 1, 9), '[^ACGT]') THEN CAST(list_sum(list_transform(range(least(9, length(seq))),
    lambda i: (strpos('ACGT', seq[i + 1]) - 1) * CAST(pow(4, least(9, length(seq)) - 1 - i) AS BIGINT))) AS BIGINT) END AS idx,
  CASE WHEN NOT regexp_matches(substr(seq, 1, 9), '[^ACGT]') THEN lpad(substr(seq, 1, 9), 9, 'A') END AS back,
  NOT regexp_matches(seq, '[^ACGT]') AS unambiguous, substr(seq, 4, 8) AS part
FROM ctg""",
    "reverse_complements": f"""WITH {SQL_CONTIGS}
SELECT genome_id, CAST(contig_no AS INTEGER) AS contig_no, CAST(length(seq) AS INTEGER) AS n, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc,
  md5(regexp_replace(translate(reverse(seq), 'ACGT', 'TGCA'), '[^ACGT]', 'N', 'g')) AS rc_n FROM ctg""",
    "adaptive_k_choice": f"""WITH {SQL_GENES}
SELECT query_name, coalesce(list_max(list_filter(range(15, 32), lambda k: length(seq) >= k AND (length(seq) - k + 1) * pow(0.95, k) >= 50)), 15)::INTEGER AS k,
  coalesce(list_max(list_filter(range(7, 32), lambda k: length(seq) >= k AND (length(seq) - k + 1) * pow(0.85, k) >= 30)), 7)::INTEGER AS k_cross FROM genes""",
    "sampled_query_kmers": f"""{_hits(100)}
SELECT query_name, n_sampled, count(*) AS n_clean, CAST(sum(pos) AS BIGINT) AS pos_sum, count(DISTINCT w) AS n_distinct FROM smp GROUP BY ALL""",
    "containment_rank": f"""{_SCORED}
SELECT query_name, genome_id, n_sampled, shared, CAST(rank AS INTEGER) AS rank, round(c, 6) AS containment, round(info, 6) AS info_score,
  round(bp, 6) AS bayes_prob, round(bq, 6) AS bayes_prob_hc, round(ba, 6) AS bayes_ani,
  round(least(1.96 * sqrt(c * (1 - c) / n_sampled) / ({K} * pow(pow(c, 1.0 / {K}), {K - 1})), 0.5), 6) AS ani_ci FROM rk""",
    "containment_chunked": f"""{_hits(500)}
SELECT query_name, genome_id, count(*) AS shared, round(sum(greatest(ln((SELECT n FROM n) / card), 0)), 6) AS info_score FROM hits GROUP BY ALL""",
    "top_genomes": f"""{_SCORED},
q AS (SELECT *, max(CASE WHEN rank = 1 THEN c END) OVER (PARTITION BY query_name) AS b,
  coalesce(max(CASE WHEN rank = 2 THEN c END) OVER (PARTITION BY query_name), 0) AS s, count(*) OVER (PARTITION BY query_name) AS m FROM rk)
SELECT query_name, genome_id, CAST(rank AS INTEGER) AS rank, shared,
  CAST(CASE WHEN m > 1 THEN least(greatest(floor(c * 30), 0) + greatest(floor((b - s) / b * 30), 0), 60) ELSE 60 END AS INTEGER) AS mapq FROM q WHERE rank <= 5""",
    "prevalence": f"""{_hits(200)},
per AS (SELECT query_name, genome_id, count(*) AS shared FROM hits GROUP BY ALL),
mx AS (SELECT query_name, max(shared) AS m, count(*) AS genomes_hit FROM per GROUP BY query_name),
b AS (SELECT query_name, min(genome_id) AS best_genome, any_value(m) AS m, count(*) AS at_best, any_value(genomes_hit) AS genomes_hit
  FROM per JOIN mx USING (query_name) WHERE shared = m GROUP BY query_name),
h AS (SELECT query_name, count(DISTINCT pos) AS kmers_hit FROM hits GROUP BY query_name)
SELECT query_name, CAST(length(seq) AS INTEGER) AS query_len, coalesce(kmers_hit, 0) AS kmers_hit, best_genome, coalesce(m, 0) AS best_shared,
  round(coalesce(m / kmers_hit, 0), 6) AS containment, coalesce(at_best, 0) AS genomes_at_best, coalesce(genomes_hit, 0) AS genomes_hit
FROM genes LEFT JOIN h USING (query_name) LEFT JOIN b USING (query_name)""",
    "sprt_decisions": f"""{_hits(384)},
d AS (SELECT DISTINCT query_name, pos FROM hits),
l AS (SELECT s.query_name, s.pos, sum(CASE WHEN d.pos IS NOT NULL THEN ln(pow(0.98, 31) / 1e-6) ELSE ln((1 - pow(0.98, 31)) / (1 - 1e-6)) END)
  OVER (PARTITION BY s.query_name ORDER BY s.pos) AS llr FROM smp s LEFT JOIN d ON d.query_name = s.query_name AND d.pos = s.pos),
c AS (SELECT *, CASE WHEN llr > ln(0.95 / 0.05) THEN 'present' WHEN llr < ln(0.05 / 0.95) THEN 'absent' END AS d FROM l)
SELECT query_name, coalesce(min_by(d, pos) FILTER (d IS NOT NULL), 'open') AS decision, CAST(min(pos) FILTER (d IS NOT NULL) AS INTEGER) AS decided_at,
  round(max_by(llr, pos), 6) AS llr FROM c GROUP BY query_name""",
    "candidate_votes": f"""WITH {_COLORS}
SELECT query_name, genome_id, count(*) AS vote_count, round(sum(log2((SELECT count(DISTINCT genome_id) FROM colors) / card)), 6) AS vote_score
FROM seeds JOIN card USING (unitig_id) JOIN colors USING (unitig_id) GROUP BY query_name, genome_id HAVING count(*) >= 2""",
    "greedy_candidates": f"""WITH {_COLORS},
r AS (SELECT query_name, unitig_id, row_number() OVER (PARTITION BY query_name ORDER BY card, unitig_id) AS r FROM seeds JOIN card USING (unitig_id)),
f AS (SELECT query_name, genome_id, min(r) AS f FROM r JOIN colors USING (unitig_id) GROUP BY ALL)
SELECT query_name, genome_id FROM (SELECT *, (SELECT count(*) FROM f g WHERE g.query_name = f.query_name AND g.f < f.f) AS before FROM f) WHERE before < 40""",
    "shard_merge": f"""{_hits(384)},
sn AS (SELECT genome_id % 2 AS shard_id, count(DISTINCT genome_id) AS n FROM ctg GROUP BY 1),
sf AS (SELECT w, genome_id % 2 AS shard_id, sum(n) AS freq, count(*) AS card FROM kg GROUP BY ALL),
sc AS (SELECT s.query_name, kg.genome_id, kg.genome_id % 2 AS shard_id, s.n_sampled, count(*) AS shared, sum(log2(sn.n / sf.card)) AS info
  FROM smp s JOIN kg USING (w) JOIN sf ON sf.w = s.w AND sf.shard_id = kg.genome_id % 2 JOIN sn ON sn.shard_id = sf.shard_id WHERE sf.freq <= 10000 GROUP BY ALL),
pr AS (SELECT *, {_prob(0.5)} AS bp FROM sc)
SELECT query_name, genome_id, CAST(shard_id AS INTEGER) AS shard_id, shared, CAST(row_number() OVER (PARTITION BY query_name ORDER BY round(info, 9) DESC, round(bp, 9) DESC, genome_id) AS INTEGER) AS rank,
  round(info, 6) AS info_score FROM pr""",
}

# over unitigs of any length; the SQL of the queries above is left as it is
ALL = [containment_rank, containment_pigeonhole, containment_chunked, containment_adaptive, top_genomes, prevalence, sprt_decisions, shard_merge]
QUERIES |= {f"{f.__name__}_all": over_all_genes(f) for f in ALL}
SQL |= {f"{f.__name__}_all": SQL[f.__name__].replace(SQL_GENES, SQL_ALL_GENES) for f in ALL if f.__name__ in SQL}
