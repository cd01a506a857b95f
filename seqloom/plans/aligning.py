"""Queries of alignment, chaining, seed scoring, index growth and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqloom.config import SearchConfig
from seqloom.functions import stats
from seqloom.functions.dna import explode_kmers, sampled_kmers
from seqloom.operators import alignment, chaining, index_store, search
from seqloom.plans.domain import SQL_ALL_GENES, SQL_CONTIGS, SQL_GENES, contigs, genes, over_all_genes, sql_kmers
from seqloom.session import ensure_checkpoint_dir, merge_join, table
from seqloom.streaming.arrivals import sessions

K = 31


def aligned_hits(spark, sf_dir, genes=genes):
    """Alignments of every gene with its best genomes."""
    g, c = genes(spark, sf_dir), contigs(spark, sf_dir)
    config = SearchConfig(kmer_size=K, max_target_seqs=10)
    out = alignment.align(g, c, search.containment(g, c, config), config)
    return out.select(
        "query_name", "genome_id", "strand", "target_start", "target_end", "num_matches", "edits", "as_score", "out_rank", F.round("identity", 6).alias("identity"), "cigar"
    )


def aligned_hits_graph(spark, sf_dir):
    g, c = genes(spark, sf_dir), contigs(spark, sf_dir)
    config = SearchConfig(kmer_size=K)
    out = alignment.align(g, c, search.containment(g, c, config), config, "graph")
    return out.select("query_name", "genome_id", "strand", "num_matches", "edits")


def _seeds(spark, sf_dir, genes=genes):
    """Every sampled position with its word's frequency and genomes."""
    g, c = genes(spark, sf_dir), contigs(spark, sf_dir)
    samples = sampled_kmers(g, ["query_name"], "seq", K, 384)
    freq = search.kmer_frequency(search.kmer_index(c, K))
    return merge_join(samples, freq, "kmer").select("query_name", "pos", F.lit(K).alias("match_len"), "freq", "card")


def seed_features(spark, sf_dir, genes=genes):
    n = search.genome_count(contigs(spark, sf_dir))
    out = chaining.seed_features(_seeds(spark, sf_dir, genes), genes(spark, sf_dir), n)
    return out.select("query_name", "pos", *[F.round(c, 6).alias(c) for c in (*stats.SEED_FEATURES[1:], "score", "weighted_score")])


def seed_scorer(spark, sf_dir):
    """Weights trained on seeds, labelled by whether the best genome of their gene holds the word."""
    g, c = genes(spark, sf_dir), contigs(spark, sf_dir)
    n = search.genome_count(c)
    _, hits = search.sampled_hits(g, c, K)
    top = search.containment(g, c, SearchConfig(kmer_size=K, max_candidates=1)).select("query_name", "genome_id")
    good = merge_join(hits, top, ["query_name", "genome_id"], "left_semi").select("query_name", "pos").distinct().withColumn("_good", F.lit(1))
    rows = merge_join(chaining.seed_features(_seeds(spark, sf_dir), g, n), good, ["query_name", "pos"], "left")
    w = chaining.train_seed_scorer(rows.withColumn("label", F.coalesce("_good", F.lit(0))))
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(zip(["bias", *stats.SEED_FEATURES], w))], "no int, feature string, weight double")


def best_chains(spark, sf_dir, genes=genes):
    g, c = genes(spark, sf_dir), contigs(spark, sf_dir)
    q = sampled_kmers(g.withColumn("query_len", F.length("seq")), ["query_name", "query_len"], "seq", K, 384)
    idx = merge_join(explode_kmers(c, ["genome_id", "base_offset"], "seq", K), q.select("kmer").distinct(), "kmer", "left_semi")
    hits = merge_join(q.withColumnRenamed("is_rc", "_q").withColumnRenamed("pos", "query_start"), idx, "kmer")
    anchors = hits.select(
        "query_name", "query_len", F.col("genome_id").cast("int").alias("genome_id"), (F.col("_q") != F.col("is_rc")).alias("is_reverse"),
        # on the other strand the reference runs backwards: mirrored, chains ascend alike
        "query_start", F.when(F.col("_q") != F.col("is_rc"), 1_000_000_000 - F.col("base_offset") - F.col("pos")).otherwise(F.col("base_offset") + F.col("pos")).alias("ref_start"),
        F.lit(K).alias("match_len"), F.lit(float(K)).alias("score"),
    )
    return chaining.chains(anchors)


def anchor_sensitivity(spark, sf_dir):
    d = spark.range(0, 31).select((F.col("id") / 100.0).alias("divergence"))
    return d.select("divergence", F.round(stats.anchor_sensitivity("divergence", 10, 3, 1), 9).alias("one_of_three"), F.round(stats.anchor_sensitivity("divergence", 10, 3, 2), 9).alias("two_of_three"))


def pigeonhole(spark, sf_dir):
    """Anchor hits of windows of 31 letters that stand nowhere whole."""
    g, c = genes(spark, sf_dir), contigs(spark, sf_dir)
    samples = sampled_kmers(g, ["query_name"], "seq", K, 384)
    solid = search.kmer_index(c, K).select("kmer").distinct()
    unsolved = merge_join(samples, solid, "kmer", "left_anti").select("query_name", "pos")
    out = chaining.anchor_hits(g, unsolved, chaining.text_words(c, ["genome_id"], 10), K, 10, 3, SearchConfig().max_seed_freq)
    return out.groupBy("query_name", "genome_id").agg(F.count_distinct("query_pos").alias("n_anchors"))


def index_growth(spark, sf_dir, genes=genes):
    """Two shards, each an index built in two steps and compacted, searched together; one row a gene and genome."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{abs(hash(sf_dir)) % 10**9}-{spark.sparkContext.applicationId}"
    c = contigs(spark, sf_dir)
    for shard in (0, 1):
        for step in (0, 1):
            index_store.build(c.where(F.col("genome_id") % 4 == shard + 2 * step), f"{folder}/grown-{shard}", K, step)
        index_store.compact(spark, f"{folder}/grown-{shard}", folder, K, shard)
    out = index_store.search_index(genes(spark, sf_dir), folder, K)
    return out.select("query_name", "genome_id", "shard_id", "shared", "rank", F.round("info_score", 6).alias("info_score"))


def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    out = sessions(e)
    return out.select("user_id", "started", "n_values", F.round("mean_value", 6).alias("mean_value"), "low", "high")


QUERIES = {
    f.__name__: f
    for f in [aligned_hits, aligned_hits_graph, seed_features, seed_scorer, best_chains, anchor_sensitivity, pigeonhole, index_growth, event_sessions]
}

_FREQ = f"""WITH {SQL_CONTIGS}, {SQL_GENES},
idx AS ({sql_kmers(K, "ctg", "genome_id, base_offset")}),
freq AS (SELECT w, count(*) AS freq, count(DISTINCT genome_id) AS card FROM idx GROUP BY w),
sized AS (SELECT *, length(seq) - {K} + 1 AS total, greatest(floor((length(seq) - {K} + 1) / 384), 1) AS stride FROM genes WHERE length(seq) >= {K}),
smp AS (SELECT query_name, pos, w FROM ({sql_kmers(K, "sized", "query_name, stride")}) WHERE pos % stride = 0)"""

_W = stats.SEED_WEIGHTS
_P = "pow(1 - divergence, 10)"

SQL = {
    "seed_features": f"""{_FREQ},
f AS (SELECT query_name, pos, freq, card, seq, length(seq) AS n, count(*) OVER (PARTITION BY query_name ORDER BY pos RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS c
  FROM smp JOIN freq USING (w) JOIN genes USING (query_name)),
g AS (SELECT query_name, pos, log2(freq) AS log_sa_count, pos / n AS query_pos_frac, {K} / n AS match_frac, CAST(card AS DOUBLE) AS color_cardinality,
  length(regexp_replace(substr(seq, CAST(pos + 1 AS BIGINT), {K}), '[^GC]', '', 'g')) / {K} AS gc_content, log2((SELECT count(DISTINCT genome_id) FROM ctg) / card) AS information_content,
  1 / freq AS inverse_sa_count, c / ((least(pos + 500, n) - greatest(pos - 500, 0)) / 1000.0) AS local_seed_density, {K} / (freq * card) AS seed_uniqueness FROM f),
s AS (SELECT *, 1 / (1 + exp(-({_W[0]} + {_W[1]} * {K} + {_W[2]} * log_sa_count + {_W[3]} * query_pos_frac + {_W[4]} * match_frac + {_W[5]} * color_cardinality + {_W[6]} * gc_content
  + {_W[7]} * information_content + {_W[8]} * inverse_sa_count + {_W[9]} * local_seed_density + {_W[10]} * seed_uniqueness))) AS score FROM g)
SELECT query_name, CAST(pos AS INTEGER) AS pos, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in stats.SEED_FEATURES[1:])}, round(score, 6) AS score, round(score * {K}, 6) AS weighted_score FROM s""",
    "anchor_sensitivity": f"""SELECT divergence, round({" + ".join(f"{math.comb(3, i)} * pow({_P}, {i}) * pow(1 - {_P}, {3 - i})" for i in (1, 2, 3))}, 9) AS one_of_three,
  round({" + ".join(f"{math.comb(3, i)} * pow({_P}, {i}) * pow(1 - {_P}, {3 - i})" for i in (2, 3))}, 9) AS two_of_three
FROM (SELECT CAST(i AS DOUBLE) / 100.0 AS divergence FROM (SELECT unnest(range(31)) AS i))""",
    "event_sessions": """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n_values, round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high FROM s GROUP BY user_id, no""",
}

# over unitigs of any length; the SQL of the queries above is left as it is
ALL = [aligned_hits, seed_features, best_chains, index_growth]
QUERIES |= {f"{f.__name__}_all": over_all_genes(f) for f in ALL}
SQL |= {f"{f.__name__}_all": SQL[f.__name__].replace(SQL_GENES, SQL_ALL_GENES) for f in ALL if f.__name__ in SQL}
