"""Containment search: which genomes hold the sampled k-mers of a query.

Data model: ``contigs`` (genome_id, contig_no, seq), ``queries`` (query_name, seq).
The index is the table of canonical k-mers of all contigs; a query's k-mers are
looked up by an equi-join on the packed word, restricted first by the distinct
words of all queries so that what is shuffled is bound by hits, not by the
collection.  Written sorted by k-mer it prunes by row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.config import SearchConfig
from seqloom.functions import stats
from seqloom.functions.dna import explode_kmers, explode_kmers_of, sampled_kmers
from seqloom.operators import chaining
from seqloom.session import cut, merge_join, salted_lookup

MIN_SOLID = 30  # a query with fewer solid hits falls back to anchors


def contigs_of(sequences: DataFrame) -> DataFrame:
    """Distinct contigs (genome_id, contig_no, contig_name, seq, base_offset) of raw rows; a genome's
    coordinates run through its contigs in the order of seq_id."""
    one = sequences.where(F.col("seq").isNotNull() & (F.length("seq") > 0) & F.col("genome_id").isNotNull()).groupBy("seq_id").agg(
        F.max(F.struct(F.length("seq").alias("n"), F.upper("seq").alias("seq"), "genome_id", "contig_name")).alias("m")
    )
    rows = one.select("seq_id", "m.genome_id", "m.contig_name", "m.seq", "m.n")
    w = Window.partitionBy("genome_id").orderBy("seq_id")
    return rows.select(
        "genome_id",
        (F.row_number().over(w) - 1).cast("int").alias("contig_no"),
        "contig_name",
        "seq",
        (F.sum("n").over(w) - F.col("n")).cast("long").alias("base_offset"),
    )


def kmer_index(contigs: DataFrame, k: int) -> DataFrame:
    """(kmer, genome_id, pos, is_rc) of every clean window; pos in genome coordinates."""
    rows = explode_kmers(contigs, ["genome_id", "base_offset"], "seq", k)
    return rows.select("kmer", "genome_id", (F.col("base_offset") + F.col("pos")).alias("pos"), "is_rc")


def kmer_genomes(index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(kmer, genome_id, n) distinct; only words of ``wanted`` (kmer) where given."""
    rows = index.select("kmer", "genome_id")
    if wanted is not None:
        rows = merge_join(rows, wanted.select("kmer").distinct(), "kmer", "left_semi")
    return rows.groupBy("kmer", "genome_id").agg(F.count(F.lit(1)).alias("n"))


def kmer_frequency(index: DataFrame) -> DataFrame:
    """(kmer, freq, card): occurrences and genomes."""
    return (
        kmer_genomes(index)
        .groupBy("kmer")
        .agg(F.sum("n").cast("long").alias("freq"), F.count(F.lit(1)).cast("long").alias("card"))
    )


def sampled_hits(queries: DataFrame, contigs: DataFrame, k: int, target: int = 384, max_freq: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(samples, hits): samples (query_name, n_sampled, pos, kmer); hits (query_name, n_sampled, pos, kmer,
    genome_id, card) of words that occur at most ``max_freq`` times."""
    samples = sampled_kmers(queries, ["query_name"], "seq", k, target)
    pairs = kmer_genomes(kmer_index(contigs, k), samples)
    # cardinality and frequency beside each pair; the cap bounds the fan-out of any word
    freq = pairs.groupBy("kmer").agg(F.sum("n").alias("_freq"), F.count(F.lit(1)).alias("card")).where(F.col("_freq") <= max_freq)
    kept = merge_join(pairs, freq, "kmer").select("kmer", "genome_id", "card")
    return samples, merge_join(samples, kept, "kmer")


def fallback_hits(queries: DataFrame, contigs: DataFrame, samples: DataFrame, hits: DataFrame, k: int, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Rows like ``hits``, without the word, of the pigeonhole fallback: in queries with fewer than ``MIN_SOLID``
    solid positions every missed window is looked up by short anchors (forward, as the original does).  A
    window credits a genome once, by the rarest anchor it shows there."""
    k_anchor, n_anchors = (7, 5) if config.cross_species else (10, 3)
    solid = hits.select("query_name", "pos").distinct()
    strong = solid.groupBy("query_name").agg(F.count(F.lit(1)).alias("_s")).where(F.col("_s") >= MIN_SOLID)
    missed = merge_join(merge_join(samples, strong, "query_name", "left_anti"), solid, ["query_name", "pos"], "left_anti").select("query_name", "n_sampled", "pos")
    words = chaining.text_words(contigs, ["genome_id"], k_anchor)
    found = chaining.anchor_hits(queries.select("query_name", "seq"), missed.select("query_name", "pos"), words, k, k_anchor, n_anchors, config.max_seed_freq)
    per = found.groupBy("query_name", "pos", "genome_id").agg(F.min("card").alias("card"))
    return merge_join(per, missed, ["query_name", "pos"]).select("query_name", "n_sampled", "pos", "genome_id", "card")


def genome_count(contigs: DataFrame) -> int:
    return int(contigs.agg(F.count_distinct("genome_id")).first()[0])


def containment(queries: DataFrame, contigs: DataFrame, config: SearchConfig = SearchConfig(), k: int | None = None, n_genomes: int | None = None) -> DataFrame:
    """Ranked candidates: shared positions, containment, information score, posterior probabilities
    and ANI of each query and genome; ``rank`` by information, then probability, then genome_id.

    With ``config.pigeonhole`` queries of few solid hits are credited by anchors too, and ``solid`` counts the
    shared positions that are whole k-mers."""
    k = k or config.kmer_size
    n_genomes = n_genomes if n_genomes is not None else genome_count(contigs)
    samples, hits = sampled_hits(queries, contigs, k, config.sample_target, config.max_seed_freq)
    solid = []
    if config.pigeonhole:
        weak = fallback_hits(queries, contigs, samples, hits, k, config).withColumn("_solid", F.lit(0))
        hits = hits.drop("kmer").withColumn("_solid", F.lit(1)).select(*weak.columns).unionByName(weak)
        solid = [F.sum("_solid").alias("solid")]
    ic = stats.information_content(float(n_genomes), "card") if config.ic_mode == "sum_log2" else stats.idf(float(n_genomes), "card")
    # a position has one k-mer, so distinct positions are rows and the sum over positions is the maximum's sum
    scored = hits.groupBy("query_name", "n_sampled", "genome_id").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(ic).alias("info_score"), *solid
    )
    return rank_candidates(add_posteriors(scored, k), config.max_candidates)


def add_posteriors(scored: DataFrame, k: int) -> DataFrame:
    return (
        scored.withColumn("containment", F.col("shared") / F.col("n_sampled"))
        .withColumn("bayes_prob", stats.match_probability("shared", "n_sampled", 0.5))
        .withColumn("bayes_prob_hc", stats.match_probability("shared", "n_sampled", 0.9))
        .withColumn("bayes_ani", stats.posterior_ani("shared", "n_sampled", k))
        .withColumn("ani_ci", stats.ani_interval("shared", "n_sampled", k))
    )


def rank_candidates(scored: DataFrame, most: int | None = None) -> DataFrame:
    order = [F.desc(F.round("info_score", 9)), F.desc(F.round(F.coalesce("bayes_prob", "containment"), 9)), F.asc("genome_id")]
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_name").orderBy(*order)))
    return out.where(F.col("rank") <= most) if most else out


def adaptive_containment(queries: DataFrame, contigs: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Each query at its own k (by length), then at smaller ones while it finds nothing.

    All k in use are taken in one pass over the contigs, of which only words that some query
    samples at that k are kept; of each query the largest k with a hit counts.
    """
    n = genome_count(contigs)
    least = 7 if config.cross_species else 15
    pick = stats.adaptive_k_cross_species if config.cross_species else stats.adaptive_k
    own = queries.select("query_name", "seq", pick(F.length("seq"), config.kmer_size).cast("int").alias("_own"), F.length("seq").alias("_len"))
    ks = sorted({k for r in own.select("_own").distinct().collect() for k in stats.fallback_ks(r[0], least)})  # at most 25 values
    total = F.col("_len") - F.col("k") + 1
    stride = F.greatest(F.floor(total / config.sample_target), F.lit(1)).cast("int")
    on_ladder = (F.col("k") <= F.col("_own")) & (((F.col("_own") - F.col("k")) % 4 == 0) | (F.col("k") == least))
    samples = (
        explode_kmers_of(own, ["query_name", "_own", "_len"], "seq", ks)
        .where(on_ladder & (F.col("pos") % stride == 0))
        .select("query_name", "k", (F.floor((total - 1) / stride) + 1).cast("int").alias("n_sampled"), "pos", "kmer")
    )
    wanted = samples.select("k", "kmer").distinct()
    pairs = (
        merge_join(explode_kmers_of(contigs, ["genome_id"], "seq", ks), wanted, ["k", "kmer"], "left_semi")
        .groupBy("k", "kmer", "genome_id").agg(F.count(F.lit(1)).alias("n"))
    )
    freq = (
        pairs.groupBy("k", "kmer").agg(F.sum("n").alias("_freq"), F.count(F.lit(1)).alias("card"))
        .where(F.col("_freq") <= config.max_seed_freq)
    )
    hits = merge_join(samples, merge_join(pairs, freq, ["k", "kmer"]).select("k", "kmer", "genome_id", "card"), ["k", "kmer"])
    scored = hits.groupBy("query_name", "k", "n_sampled", "genome_id").agg(
        F.count(F.lit(1)).alias("shared"), F.sum(stats.information_content(float(n), "card")).alias("info_score")
    )
    first = scored.withColumn("_top", F.max("k").over(Window.partitionBy("query_name"))).where(F.col("k") == F.col("_top")).drop("_top")
    ani = F.pow((F.col("shared") + 1.0) / (F.col("n_sampled") + 2.0), 1.0 / F.col("k"))
    return rank_candidates(add_posteriors(first, config.kmer_size).withColumn("bayes_ani", ani).drop("ani_ci"), config.max_candidates)


def prevalence(queries: DataFrame, contigs: DataFrame, k: int = 31, target: int = 200, max_freq: int = 10_000) -> DataFrame:
    """One row per query: k-mers that hit, best genome (least id of the ties), its shared k-mers and
    containment, genomes at that maximum and genomes hit at all."""
    _, hits = sampled_hits(queries, contigs, k, target, max_freq)
    n_hit = hits.select("query_name", "pos").distinct().groupBy("query_name").agg(F.count(F.lit(1)).alias("kmers_hit"))
    per = cut(hits.groupBy("query_name", "genome_id").agg(F.count(F.lit(1)).alias("shared")))  # used twice
    best = per.groupBy("query_name").agg(
        F.min(F.struct((-F.col("shared")).alias("neg"), "genome_id")).alias("b"), F.count(F.lit(1)).alias("genomes_hit")
    )
    at_best = (
        per.groupBy("query_name", "shared").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("query_name").agg(F.max(F.struct("shared", "n")).alias("m"))
    )
    none = F.lit(0).cast("long")
    out = queries.select("query_name", F.length("seq").alias("query_len"))
    for part in (n_hit, best, at_best):
        out = merge_join(out, part, "query_name", "left")
    return out.select(
        "query_name",
        "query_len",
        F.coalesce("kmers_hit", none).alias("kmers_hit"),
        F.col("b.genome_id").alias("best_genome"),
        F.coalesce(-F.col("b.neg"), none).alias("best_shared"),
        F.when(F.col("kmers_hit") > 0, -F.col("b.neg") / F.col("kmers_hit")).otherwise(F.lit(0.0)).alias("containment"),
        F.coalesce("m.n", none).alias("genomes_at_best"),
        F.coalesce("genomes_hit", none).alias("genomes_hit"),
    )


# ---- seeds, votes, candidate sets ----------------------------------------------


def candidate_votes(seeds: DataFrame, colors: DataFrame, n_genomes: int, min_votes: int = 1) -> DataFrame:
    """Information-weighted votes: each unitig of a query once; ``seeds`` (query_name, unitig_id),
    ``colors`` (unitig_id, genome_id)."""
    card = colors.groupBy("unitig_id").agg(F.count(F.lit(1)).alias("card"))
    once = seeds.select("query_name", "unitig_id").distinct()
    votes = salted_lookup(once, card, "unitig_id", F.col("query_name")).join(colors, "unitig_id")
    return (
        votes.groupBy("query_name", "genome_id")
        .agg(F.sum(stats.information_content(float(n_genomes), "card")).alias("vote_score"), F.count(F.lit(1)).alias("vote_count"))
        .where(F.col("vote_count") >= min_votes)
    )


def greedy_candidates(hit_unitigs: DataFrame, colors: DataFrame, most: int = 8_000) -> DataFrame:
    """(query_name, genome_id): colour sets of a query's unitigs added rarest first, until ``most``
    genomes stand: a genome is kept if fewer than ``most`` came in before the unitig that brings it."""
    card = colors.groupBy("unitig_id").agg(F.count(F.lit(1)).alias("card"))
    ranked = (
        hit_unitigs.select("query_name", "unitig_id").distinct().join(card, "unitig_id")
        .withColumn("_r", F.row_number().over(Window.partitionBy("query_name").orderBy("card", "unitig_id")))
    )
    first = ranked.join(colors, "unitig_id").groupBy("query_name", "genome_id").agg(F.min("_r").alias("_first"))
    per = first.groupBy("query_name", "_first").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("query_name").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1))
    )
    keep = before.where(F.coalesce("_before", F.lit(0)) < most).select("query_name", "_first")
    return first.join(keep, ["query_name", "_first"]).select("query_name", "genome_id")


def capped_seeds(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """First max(len / 16, 64) seeds of each query and genome, in the order of positions."""
    cap = queries.select("query_name", F.greatest(F.floor(F.length("seq") / 16), F.lit(64)).alias("_cap"))
    w = Window.partitionBy("query_name", "genome_id").orderBy("pos", "kmer")
    return hits.join(cap, "query_name").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_cap")).drop("_r", "_cap")


def mapping_quality(ranked: DataFrame) -> DataFrame:
    """Adds ``mapq``: 60 for an only candidate, else a containment part and a part for the gap between
    the first and the second candidate, each up to 30."""
    w = Window.partitionBy("query_name")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("containment"))).over(w)
    best, second = at(1), F.coalesce(at(2), F.lit(0.0))
    gap = F.when(best > 0, (best - second) / best).otherwise(F.lit(0.0))
    part = lambda x: F.greatest(F.floor(x * 30), F.lit(0))
    many = F.count(F.lit(1)).over(w) > 1
    return ranked.withColumn("mapq", F.when(many, F.least(part(F.col("containment")) + part(gap), F.lit(60))).otherwise(60).cast("int"))


def sprt_trace(samples: DataFrame, hit_positions: DataFrame, **rates) -> DataFrame:
    """Sequential test over a query's sampled positions: decision, position of the decision and final
    ratio.  A diagnostic: it never changes a ranking."""
    s = stats.sprt_steps(**rates)
    rows = merge_join(
        samples.select("query_name", "pos"), hit_positions.select("query_name", "pos").distinct().withColumn("_hit", F.lit(True)), ["query_name", "pos"], "left"
    )
    w = Window.partitionBy("query_name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_hit"), F.lit(s["hit"])).otherwise(F.lit(s["miss"]))
    llr = rows.withColumn("llr", F.sum(step).over(w))
    crossing = F.when(F.col("llr") > s["high"], F.lit("present")).when(F.col("llr") < s["low"], F.lit("absent"))
    return llr.groupBy("query_name").agg(
        F.coalesce(F.min(F.when(crossing.isNotNull(), F.struct("pos", crossing.alias("d"))))["d"], F.lit("open")).alias("decision"),
        F.min(F.when(crossing.isNotNull(), F.col("pos"))).alias("decided_at"),
        F.max_by("llr", "pos").alias("llr"),
    )


# ---- shards --------------------------------------------------------------------


def sharded_containment(queries: DataFrame, contigs: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Search of several shards (``shard_id`` on contigs): scores use each shard's own number of
    genomes, then all candidates of a query are ranked together."""
    shards = [r[0] for r in contigs.select("shard_id").distinct().orderBy("shard_id").collect()]
    parts = [
        containment(queries, contigs.where(F.col("shard_id") == s), config).drop("rank").withColumn("shard_id", F.lit(s)) for s in shards
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rank_candidates(out, config.max_candidates)
