"""Queries over alignment records, summaries, text formats and the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions.dna import explode_kmers
from seqloom.operators import graph, search, summaries
from seqloom.plans.domain import SQL_CONTIGS, contigs, sql_kmers
from seqloom.session import merge_join, table
from seqloom.sinks import text
from seqloom.sources.paf import COLUMNS, parse_paf

GENOMES = 1248  # size of the collection in prevalence figures


def _paf(spark, sf_dir):
    return table(spark, sf_dir, "paf_records")


def _valid(spark, sf_dir):
    return _paf(spark, sf_dir).where(
        F.col("query_name").isNotNull() & F.col("num_matches").isNotNull() & F.col("alignment_len").isNotNull() & F.col("target_name").isNotNull()
    )


def species_summary(spark, sf_dir):
    out = summaries.species_summary(_valid(spark, sf_dir), GENOMES, ["query_name"])
    reals = ["prevalence", "mean_identity", "median_identity", "stdev_identity", "min_identity", "max_identity"]
    return out.select("query_name", "species", "hit_count", "genome_count", *[F.round(c, 6).alias(c) for c in reals], "unique_variants")


def surveillance(spark, sf_dir):
    out = summaries.aggregate_species(summaries.species_summary(_valid(spark, sf_dir), GENOMES, ["query_name"]), GENOMES)
    return out.select(
        "species", "queries_with_hits", F.col("total_hits").cast("bigint").alias("total_hits"), F.col("total_genomes").cast("bigint").alias("total_genomes"),
        F.round("mean_identity_across_queries", 6).alias("mean_identity_across_queries"), F.round("prevalence", 6).alias("prevalence"),
    )


def surveillance_json(spark, sf_dir):
    q = _valid(spark, sf_dir).groupBy("query_name").agg(F.max("query_len").alias("query_len"))
    return summaries.surveillance_json(_valid(spark, sf_dir), q, GENOMES)


def surveillance_text(spark, sf_dir):
    q = _valid(spark, sf_dir).groupBy("query_name").agg(F.max("query_len").alias("query_len"))
    per, _ = summaries.surveillance(_valid(spark, sf_dir), q, GENOMES)
    return text.surveillance_lines(per)


def paf_roundtrip(spark, sf_dir):
    """Records written as text and parsed again."""
    rows = _valid(spark, sf_dir).fillna(0, ["mapq"]).fillna("+", ["strand"])
    back = parse_paf(text.paf_lines(rows))
    return back.select(*[c for c in COLUMNS], F.size("tags").cast("int").alias("n_tags"))


def blast_table(spark, sf_dir):
    b = text.blast_columns(_valid(spark, sf_dir).where(F.col("alignment_len") > 0), 5_000_000)
    return b.select(
        "qseqid", "sseqid", F.round("pident", 4).alias("pident"), "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send",
        F.round("bitscore", 4).alias("bitscore"), F.when(F.col("evalue") < 1e300, F.round(F.log10(F.greatest("evalue", F.lit(1e-290))), 4)).alias("log_evalue"),
    )


def best_per_target(spark, sf_dir):
    """Filters by identity, coverage and score ratio, then the best record of each target, ten a query."""
    r = summaries.with_identity(_valid(spark, sf_dir).where(F.col("query_len") > 0))
    cover = (F.col("query_end") - F.col("query_start")) / F.col("query_len")
    r = r.where((F.col("identity") >= 0.7) & (cover >= 0.3))
    order = [F.desc("num_matches"), F.asc("target_name"), F.asc("target_start"), F.asc_nulls_first("strand"), F.asc("rec_id")]
    w = Window.partitionBy("query_name").orderBy(*order)
    r = r.withColumn("_first", F.first("num_matches").over(w)).where(F.col("num_matches") >= 0.1 * F.col("_first"))
    r = r.withColumn("_t", F.row_number().over(Window.partitionBy("query_name", "target_name").orderBy(*order))).where("_t = 1")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10).select("query_name", "rank", "rec_id", "target_name", "num_matches")


def _steps(spark, sf_dir):
    return graph.path_steps(table(spark, sf_dir, "genome_paths"))


def path_edges(spark, sf_dir):
    return graph.successor_edges(_steps(spark, sf_dir))


def unitig_colors(spark, sf_dir):
    """Cardinality, information, idf, private flag and centrality of unitigs."""
    c = graph.colors_of(table(spark, sf_dir, "subgraph_nodes"))
    n = c.agg(F.count_distinct("genome_id")).first()[0]
    out = graph.color_statistics(c, n, graph.successor_edges(_steps(spark, sf_dir)))
    return out.select("unitig_id", "card", "is_private", *[F.round(x, 6).alias(x) for x in ("information_content", "idf", "centrality")])


def color_sets(spark, sf_dir):
    pool, _ = graph.color_sets(graph.colors_of(table(spark, sf_dir, "subgraph_nodes")))
    return pool.select("set_key", F.size("genomes").alias("card"), "n_unitigs")


def specificity(spark, sf_dir):
    nodes = table(spark, sf_dir, "subgraph_nodes")
    c = graph.colors_of(nodes)
    n = c.agg(F.count_distinct("genome_id")).first()[0]
    seeds = nodes.where(F.col("query_name").isNotNull() & F.col("unitig_id").isNotNull())
    return graph.specificity(seeds, c, n).withColumn("score", F.round("score", 6))


def high_card_truncation(spark, sf_dir):
    c = graph.colors_of(table(spark, sf_dir, "subgraph_nodes"))
    n = c.agg(F.count_distinct("genome_id")).first()[0]
    return graph.truncated_colors(c, n, n).groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_unitigs"))


def _unitigs(spark, sf_dir):
    u = table(spark, sf_dir, "unitigs").where(F.col("sequence").isNotNull())
    return u.groupBy("unitig_id").agg(F.max(F.upper("sequence")).alias("seq"))


def built_paths(spark, sf_dir):
    """Paths of the contigs through the unitigs, spelled anew from sequence (k = 31)."""
    words = explode_kmers(_unitigs(spark, sf_dir), ["unitig_id"], "seq", 31)
    return graph.build_paths(search.kmer_index(contigs(spark, sf_dir), 31), graph.unitig_kmers(words))


def _context(spark, sf_dir):
    recs = _valid(spark, sf_dir).where(F.col("target_start").isNotNull() & F.col("target_end").isNotNull())
    lengths = _unitigs(spark, sf_dir).select("unitig_id", F.length("seq").alias("unitig_len"))
    return graph.hit_context(recs.select("rec_id", "target_name", "target_start", "target_end"), _steps(spark, sf_dir), lengths, 1)


def hit_nodes(spark, sf_dir):
    return _context(spark, sf_dir)[0]


def hit_edges(spark, sf_dir):
    return _context(spark, sf_dir)[1]


def hit_gfa(spark, sf_dir):
    """Graph text round hits: header, segment and link lines."""
    nodes, edges = _context(spark, sf_dir)
    c = graph.colors_of(table(spark, sf_dir, "subgraph_nodes"))
    n = c.agg(F.count_distinct("genome_id")).first()[0]
    full = graph.colored_nodes(nodes, c, n, _unitigs(spark, sf_dir)).withColumnRenamed("rec_id", "subgraph")
    return text.gfa_lines(full, edges.withColumnRenamed("rec_id", "subgraph"))


def compacted_unitigs(spark, sf_dir):
    """Lengths of the maximal chains of 31-letter words of the contigs, forward strand, colours kept apart."""
    seqs = contigs(spark, sf_dir)
    words = explode_kmers(seqs, ["genome_id"], "seq", 31)
    # oriented words: the canonical one and its strand make 2 * kmer + strand unambiguous
    oriented = words.select((F.col("kmer") * 2 + F.col("is_rc").cast("long")).alias("kmer"), "genome_id")
    keys = oriented.groupBy("kmer").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_set("genome_id")), lambda g: g.cast("string")), ",")).alias("color_key"))
    ends = graph_ends(seqs, 31)
    chains = graph.compact_unitigs(merge_join(ends, keys, "kmer"))
    return chains.groupBy("chain").agg(F.count(F.lit(1)).alias("n_words")).groupBy("n_words").agg(F.count(F.lit(1)).alias("n_chains"))


def graph_ends(seqs, k):
    """(kmer, prefix, suffix): oriented words with the words of k - 1 letters they begin and end with."""
    small = explode_kmers(seqs, ["genome_id", "contig_no"], "seq", k - 1).select(
        "genome_id", "contig_no", "pos", (F.col("kmer") * 2 + F.col("is_rc").cast("long")).alias("part")
    )
    w = Window.partitionBy("genome_id", "contig_no").orderBy("pos")
    pairs = small.select("genome_id", "contig_no", "pos", F.col("part").alias("prefix"), F.lead("part").over(w).alias("suffix"), F.lead("pos").over(w).alias("_next"))
    pairs = pairs.where(F.col("_next") == F.col("pos") + 1)
    big = explode_kmers(seqs, ["genome_id", "contig_no"], "seq", k).select(
        "genome_id", "contig_no", "pos", (F.col("kmer") * 2 + F.col("is_rc").cast("long")).alias("kmer")
    )
    return merge_join(big, pairs, ["genome_id", "contig_no", "pos"]).groupBy("kmer").agg(F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"))


QUERIES = {
    f.__name__: f
    for f in [
        species_summary, surveillance, surveillance_json, surveillance_text, paf_roundtrip, blast_table, best_per_target, path_edges,
        unitig_colors, color_sets, specificity, high_card_truncation, built_paths, hit_nodes, hit_edges, hit_gfa, compacted_unitigs,
    ]
}

_VALID = "valid AS (SELECT * FROM paf_records WHERE query_name IS NOT NULL AND num_matches IS NOT NULL AND alignment_len IS NOT NULL AND target_name IS NOT NULL)"
_SPECIES = f"""{_VALID},
stem AS (SELECT *, CASE WHEN query_len > 0 THEN num_matches / query_len ELSE 0 END AS identity, regexp_replace(target_name, '(\\.fa)*(\\.fasta)*(\\.fna)*$', '') AS stem FROM valid),
sp AS (SELECT *, CASE WHEN contains(stem, '_') THEN split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2)
  WHEN contains(stem, '.') THEN split_part(stem, '.', 1) || '_' || split_part(stem, '.', 2) ELSE stem END AS species FROM stem),
per AS (SELECT query_name, species, count(*) AS hit_count, count(DISTINCT target_name) AS genome_count, avg(identity) AS mean_identity, median(identity) AS median_identity,
  coalesce(stddev_samp(identity), 0) AS stdev_identity, min(identity) AS min_identity, max(identity) AS max_identity, count(DISTINCT floor(identity * 1000)) AS unique_variants FROM sp GROUP BY ALL)"""
_STEPS = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY len(steps) DESC, loaded_at DESC NULLS LAST, genome_name NULLS FIRST) AS r
  FROM genome_paths WHERE genome_id IS NOT NULL AND steps IS NOT NULL) WHERE r = 1),
steps AS (SELECT genome_id, genome_name, i - 1 AS step_idx, s.unitig_id AS unitig_id, coalesce(s.is_reverse, false) AS is_reverse, s.genome_offset AS genome_offset
  FROM (SELECT genome_id, genome_name, unnest(steps) AS s, unnest(range(1, len(steps) + 1)) AS i FROM one))"""
_EDGES = f"""{_STEPS},
e0 AS (SELECT CAST(unitig_id AS BIGINT) * 2 + is_reverse::INT AS src, lead(CAST(unitig_id AS BIGINT) * 2 + is_reverse::INT) OVER (PARTITION BY genome_id ORDER BY step_idx) AS dst FROM steps),
edges AS (SELECT DISTINCT src, dst FROM e0 WHERE src IS NOT NULL AND dst IS NOT NULL)"""
_COLORS = "colors AS (SELECT DISTINCT unitig_id, genome_id FROM (SELECT unitig_id, unnest(genome_ids) AS genome_id FROM subgraph_nodes) WHERE unitig_id IS NOT NULL AND genome_id IS NOT NULL)"
_CONTEXT = f"""{_VALID}, {_STEPS},
ulen AS (SELECT unitig_id, length(max(upper(sequence))) AS n FROM unitigs WHERE sequence IS NOT NULL GROUP BY unitig_id),
sized AS (SELECT steps.*, genome_offset + coalesce(n, 1000) AS e FROM steps LEFT JOIN ulen USING (unitig_id)),
lastof AS (SELECT genome_id, genome_name, max(step_idx) AS l FROM steps GROUP BY ALL),
ov AS (SELECT rec_id, s.genome_id, l, s.step_idx FROM valid v JOIN lastof b ON
    (regexp_matches(v.target_name, '^genome_[0-9]+$') AND try_cast(substr(v.target_name, 8) AS INT) = b.genome_id)
    OR (NOT regexp_matches(v.target_name, '^genome_[0-9]+$') AND v.target_name = b.genome_name)
  JOIN sized s ON s.genome_id = b.genome_id AND s.genome_offset < v.target_end AND s.e > v.target_start),
span AS (SELECT rec_id, genome_id, greatest(min(step_idx) - 1, 0) AS f, least(max(step_idx) + 1, any_value(l)) AS t FROM ov GROUP BY rec_id, genome_id),
linked AS (SELECT *, lead(unitig_id) OVER w AS to_unitig, lead(is_reverse) OVER w AS to_rev FROM steps WINDOW w AS (PARTITION BY genome_id ORDER BY step_idx)),
inside AS (SELECT rec_id, span.t, linked.* FROM span JOIN linked USING (genome_id) WHERE step_idx BETWEEN f AND t AND unitig_id IS NOT NULL)"""

SQL = {
    "species_summary": f"""WITH {_SPECIES}
SELECT query_name, species, hit_count, genome_count, round(genome_count / {GENOMES}, 6) AS prevalence, round(mean_identity, 6) AS mean_identity, round(median_identity, 6) AS median_identity,
  round(stdev_identity, 6) AS stdev_identity, round(min_identity, 6) AS min_identity, round(max_identity, 6) AS max_identity, unique_variants FROM per""",
    "surveillance": f"""WITH {_SPECIES}
SELECT species, count(*) AS queries_with_hits, CAST(sum(hit_count) AS BIGINT) AS total_hits, CAST(sum(genome_count) AS BIGINT) AS total_genomes,
  round(avg(mean_identity), 6) AS mean_identity_across_queries, round(sum(genome_count) / {GENOMES}, 6) AS prevalence FROM per GROUP BY species""",
    "paf_roundtrip": f"""WITH {_VALID}
SELECT query_name, query_len, query_start, query_end, coalesce(strand, '+') AS strand, target_name, target_len, target_start, target_end, num_matches, alignment_len,
  coalesce(mapq, 0) AS mapq, CAST(coalesce(len(list_filter(tags, lambda t: t IS NOT NULL)), 0) AS INTEGER) AS n_tags FROM valid""",
    "blast_table": f"""WITH {_VALID},
t AS (SELECT *, try_cast(regexp_extract(list_filter(tags, lambda t: starts_with(t, 'NM:'))[1], '^[^:]*:[^:]*:(.*)$', 1) AS INTEGER) AS nm,
  greatest(query_end - query_start, num_matches) AS l FROM valid WHERE alignment_len > 0),
m AS (SELECT *, coalesce(nm, greatest(alignment_len - num_matches, 0)) AS x FROM t), s AS (SELECT *, num_matches - 2 * x AS raw FROM m),
b AS (SELECT *, CASE WHEN raw > 0 THEN (1.374 * raw - ln(0.711)) / ln(2) ELSE 0 END AS bits FROM s)
SELECT query_name AS qseqid, target_name AS sseqid, round(CASE WHEN l > 0 THEN least(num_matches / l * 100, 100) ELSE CASE WHEN query_len > 0 THEN num_matches / query_len * 100 ELSE 0 END END, 4) AS pident,
  l AS length, x AS mismatch, 0 AS gapopen, query_start + 1 AS qstart, query_end AS qend, target_start + 1 AS sstart, target_end AS send, round(bits::DOUBLE, 4) AS bitscore,
  CASE WHEN raw > 0 THEN round(log10(greatest(greatest(query_len, 1)::DOUBLE * 5000000.0::DOUBLE * pow(2, -bits), 1e-290)), 4) END AS log_evalue FROM b""",
    "best_per_target": f"""WITH {_VALID},
f AS (SELECT * FROM valid WHERE query_len > 0 AND num_matches / query_len >= 0.7 AND (query_end - query_start) / query_len >= 0.3),
g AS (SELECT *, first(num_matches) OVER (PARTITION BY query_name ORDER BY num_matches DESC, target_name, target_start, strand NULLS FIRST, rec_id) AS m FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_name, target_name ORDER BY num_matches DESC, target_name, target_start, strand NULLS FIRST, rec_id) AS t FROM g WHERE num_matches >= 0.1 * m),
i AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY num_matches DESC, target_name, target_start, strand NULLS FIRST, rec_id) AS rank FROM h WHERE t = 1)
SELECT query_name, CAST(rank AS INTEGER) AS rank, rec_id, target_name, num_matches FROM i WHERE rank <= 10""",
    "path_edges": f"WITH {_EDGES} SELECT src, dst FROM edges",
    "unitig_colors": f"""WITH {_EDGES}, {_COLORS},
c AS (SELECT unitig_id, count(*) AS card FROM colors GROUP BY unitig_id), n AS (SELECT count(DISTINCT genome_id) AS n FROM colors),
d AS (SELECT CAST(floor(src / 2) AS INTEGER) AS unitig_id, count(DISTINCT dst) AS degree FROM edges GROUP BY 1)
SELECT unitig_id, card, card <= 3 AS is_private, round(log2(n / card), 6) AS information_content, round(greatest(ln(n / card), 0), 6) AS idf,
  round(greatest(ln(n / card), 0) * ln(1 + coalesce(degree, 0)), 6) AS centrality FROM c CROSS JOIN n LEFT JOIN d USING (unitig_id)""",
    "color_sets": f"""WITH {_COLORS}, s AS (SELECT unitig_id, list(genome_id ORDER BY genome_id) AS g FROM colors GROUP BY unitig_id)
SELECT md5(array_to_string(g, ',')) AS set_key, CAST(len(any_value(g)) AS INTEGER) AS card, count(*) AS n_unitigs FROM s GROUP BY 1""",
    "specificity": f"""WITH {_COLORS}, p AS (SELECT unitig_id FROM colors GROUP BY unitig_id HAVING count(*) <= 3),
q AS (SELECT DISTINCT query_name, unitig_id FROM subgraph_nodes WHERE query_name IS NOT NULL AND unitig_id IS NOT NULL)
SELECT query_name, genome_id, count(*) AS private_hits, round(count(*) * log2((SELECT count(DISTINCT genome_id) FROM colors) / 3), 6) AS score
FROM q JOIN p USING (unitig_id) JOIN colors USING (unitig_id) GROUP BY ALL""",
    "high_card_truncation": f"WITH {_COLORS} SELECT genome_id, count(*) AS n_unitigs FROM colors GROUP BY genome_id",
    "built_paths": f"""WITH {SQL_CONTIGS},
us AS (SELECT unitig_id, max(upper(sequence)) AS seq FROM unitigs WHERE sequence IS NOT NULL GROUP BY unitig_id),
uw0 AS (SELECT unitig_id, pos, substr(seq, CAST(pos + 1 AS BIGINT), 31) AS g FROM (SELECT unitig_id, seq, unnest(range(greatest(length(seq) - 30, 0))) AS pos FROM us)),
gw0 AS (SELECT genome_id, base_offset + pos AS pos, substr(seq, CAST(pos + 1 AS BIGINT), 31) AS g FROM (SELECT genome_id, base_offset, seq, unnest(range(greatest(length(seq) - 30, 0))) AS pos FROM ctg)),
uw AS (SELECT unitig_id, pos, least(g, rc) AS w, g > rc AS flip FROM (SELECT *, reverse(translate(g, 'ACGT', 'TGCA')) AS rc FROM uw0 WHERE NOT regexp_matches(g, '[^ACGT]'))),
gw AS (SELECT genome_id, pos, least(g, rc) AS w, g > rc AS flip FROM (SELECT *, reverse(translate(g, 'ACGT', 'TGCA')) AS rc FROM gw0 WHERE NOT regexp_matches(g, '[^ACGT]'))),
tab AS (SELECT w, min((unitig_id, pos, flip)) AS m FROM uw GROUP BY w),
j AS (SELECT genome_id, pos, struct_extract_at(m, 1) AS unitig_id, flip <> struct_extract_at(m, 3) AS is_reverse FROM gw LEFT JOIN tab USING (w)),
l AS (SELECT *, lag(unitig_id) OVER x AS pu, lag(is_reverse) OVER x AS pr, lag(pos) OVER x AS pp FROM j WINDOW x AS (PARTITION BY genome_id ORDER BY pos)),
k AS (SELECT * FROM l WHERE unitig_id IS NOT NULL AND (pu IS NULL OR pu <> unitig_id OR pr <> is_reverse OR pp <> pos - 1))
SELECT genome_id, CAST(row_number() OVER (PARTITION BY genome_id ORDER BY pos) - 1 AS INTEGER) AS step_idx, unitig_id, is_reverse, CAST(pos AS BIGINT) AS genome_offset FROM k""",
    "hit_nodes": f"""WITH {_CONTEXT}
SELECT i.rec_id, i.unitig_id, bool_or(o.step_idx IS NOT NULL) AS is_hit FROM inside i LEFT JOIN (SELECT DISTINCT rec_id, step_idx FROM ov) o ON o.rec_id = i.rec_id AND o.step_idx = i.step_idx GROUP BY ALL""",
    "hit_edges": f"""WITH {_CONTEXT}
SELECT DISTINCT rec_id, unitig_id AS from_unitig, CASE WHEN is_reverse THEN '-' ELSE '+' END AS from_orient, to_unitig, CASE WHEN to_rev THEN '-' ELSE '+' END AS to_orient
FROM inside WHERE step_idx < t AND to_unitig IS NOT NULL""",
}
