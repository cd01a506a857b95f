"""Named queries of the training-data operators and, where SQL can say it, their counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.names import species_of
from seqloom.llm import digest as dg
from seqloom.llm import distinctive, packing, records, set_join, shared_spans, text_quality, tokens, top_n
from seqloom.llm.skew import Spread
from seqloom.session import cut, table

# ---- 2 ---------------------------------------------------------------------


def p2_found(spark, sf_dir):
    return distinctive.marking_genomes(table(spark, sf_dir, "subgraph_nodes")).select("query_name", "genome_id")


def p2_scores(spark, sf_dir):
    rows = distinctive.distinctive_terms(table(spark, sf_dir, "subgraph_nodes"))
    return rows.select(
        "query_name", "genome_id", "degree", "n_in", "n_unitigs", "n_records", F.round("score", 6).alias("score")
    )


def p2_unitig_idf(spark, sf_dir):
    """Stored weights beside the recomputed ones."""
    info = distinctive.unitig_information(table(spark, sf_dir, "subgraph_nodes"))
    cache = table(spark, sf_dir, "kmer_cache").select("unitig_id", "batch_id", F.col("unitig_idf").cast("double").alias("stored"))
    off = F.abs(F.col("stored") - F.col("idf")) > 0.001
    return cache.join(info, "unitig_id").select(
        "unitig_id", "batch_id", "n_genomes", F.round("idf", 5).alias("idf"), F.round("information", 5).alias("information"),
        F.coalesce(off, F.lit(True)).alias("is_off"),
    )


# ---- 3 ---------------------------------------------------------------------


def _both(spark, sf_dir, fn):
    path = fn(set_join.path_elements(table(spark, sf_dir, "genome_paths")))
    node = fn(set_join.node_elements(table(spark, sf_dir, "subgraph_nodes")))
    return path.select(F.lit("path").alias("kind"), "*").unionByName(node.select(F.lit("node").alias("kind"), "*"))


def p3_found(spark, sf_dir):
    return _both(spark, sf_dir, set_join.similar_pairs)


def p3_classes(spark, sf_dir):
    return _both(spark, sf_dir, set_join.linked_classes)


# ---- 4 ---------------------------------------------------------------------

PERIOD = ["query_name", "species", "day_from", "day_to"]


def _stated(summary):
    m = F.col("median_identity")
    return summary.where(m.isNotNull() & ~F.isnan(m) & F.col("query_name").isNotNull() & F.col("species").isNotNull())


def _in_period(rows, periods, spread=None):
    """Rows beside each period of their query and species; large groups are split by the measured ``spread``."""
    on = ["query_name", "species"]
    if spread is not None and spread.hot is not None:
        rows, periods, on = spread.facts(rows, F.col("run_day")), spread.lookup(periods), [*on, "_salt"]
    out = rows.join(periods, on).where(F.col("run_day").between(F.col("day_from"), F.col("day_to")))
    return out.drop("_salt") if "_salt" in on else out


def _usable(spark, sf_dir):
    """Usable records, and the sizes of groups by query, species and day, and by query and species."""
    paf = table(spark, sf_dir, "paf_records")
    named = paf.where(F.col("query_name").isNotNull()).select("query_name", species_of("target_name").alias("species"), "run_day")
    by_pair = Spread.measure(named, ["query_name", "species"])
    by_day = Spread.measure(named, ["query_name", "species", "run_day"]) if by_pair.hot is not None else Spread(["query_name", "species", "run_day"], None)
    return records.usable_records(paf), by_day, by_pair


def _day_digests(recs, by_day, value, delta=dg.DELTA):
    rows = by_day.facts(recs.select("rec_id", "query_name", "species", "run_day", value), F.col("rec_id"))
    return dg.digest(rows, ["query_name", "species"], ["run_day", "_salt"], value, delta)


def _bounds(parts):
    """Certain bounds of the median of each period, by merged digests."""
    return dg.brackets(dg.merge(parts, PERIOD, FINE), PERIOD, F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)


FINE = 2_000.0  # size of the digests that medians are bounded by: steps of at most about 1/600 of the values
TOLERANCE = 0.005
MOST_OPEN = 100_000  # periods left open that may be broadcast (about 6 MB)


def p4_found(spark, sf_dir):
    """Stated medians that the bounds of merged digests contradict.  Where bounds leave it open the exact
    median is selected between them."""
    recs, by_day, by_pair = _usable(spark, sf_dir)
    stated = _stated(table(spark, sf_dir, "species_summary")).select("summary_id", "median_identity", *PERIOD)
    parts = _in_period(_day_digests(recs, by_day, "identity", FINE), stated.select(*PERIOD).distinct(), by_pair)
    settled = cut(dg.settle(stated.join(_bounds(parts), PERIOD), "median_identity", TOLERANCE))
    found = settled.where("off").select("summary_id")
    left = settled.where("off IS NULL")
    n = left.limit(MOST_OPEN + 1).count()
    if not n:
        return found
    bounds = left.select(*PERIOD, "n", "lo", "hi").distinct()
    bounds, by_pair = (F.broadcast(bounds), None) if n <= MOST_OPEN else (bounds, by_pair)
    medians = dg.exact_medians(_in_period(recs.select("query_name", "species", "run_day", "identity"), bounds, by_pair), PERIOD, "identity")
    again = left.join(medians.select(*PERIOD, "median"), PERIOD).where(F.abs(F.col("median_identity") - F.col("median")) > TOLERANCE)
    return found.unionByName(again.select("summary_id"))


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def p4_species(spark, sf_dir):
    """Percentiles of each species alone, out of its digests by day, with certified rank error."""
    paf = table(spark, sf_dir, "paf_records")
    recs = records.usable_records(paf).where(F.col("species").isNotNull())
    sizes = Spread.measure(paf.select(species_of("target_name").alias("species"), "run_day"), ["species", "run_day"])

    def one(name):
        rows = sizes.facts(recs.select("rec_id", "species", "run_day", name), F.col("rec_id"))
        est = dg.estimate(dg.merge(dg.digest(rows, ["species"], ["run_day", "_salt"], name), ["species"]), ["species"], QUANTILES)
        return dg.certify(recs, ["species"], name, est).select("species", F.lit(name).alias("measure"), "quantile", "n", "estimate", "rank_error")

    return one("identity").unionByName(one("alignment_len"))


def p4_periods(spark, sf_dir):
    """Percentiles of each query, species and period of a summary, with certified rank error."""
    recs, by_day, by_pair = _usable(spark, sf_dir)
    periods = _stated(table(spark, sf_dir, "species_summary")).select(*PERIOD).distinct()

    def one(name):
        parts = _in_period(_day_digests(recs, by_day, name), periods, by_pair)
        est = dg.estimate(dg.merge(parts, PERIOD), PERIOD, QUANTILES)
        out = dg.certify(_in_period(recs, periods, by_pair), PERIOD, name, est)
        return out.select(*PERIOD, F.lit(name).alias("measure"), "quantile", "n", "estimate", "rank_error")

    return one("identity").unionByName(one("alignment_len"))


# ---- 5 ---------------------------------------------------------------------


def _sequence_records(spark, sf_dir):
    return shared_spans.all_records(table(spark, sf_dir, "sequences"), table(spark, sf_dir, "unitigs"))


def p5_found(spark, sf_dir):
    spans = shared_spans.shared_spans(_sequence_records(spark, sf_dir))
    return shared_spans.named(spans).select("rec_kind", "rec_id", "span_start", "span_end")


def p5_shares(spark, sf_dir):
    recs = _sequence_records(spark, sf_dir)
    rows = shared_spans.named(shared_spans.shared_share(recs, shared_spans.shared_spans(recs)))
    return rows.select("rec_kind", "rec_id", "n_letters", "n_spans", "n_shared", F.round("share", 6).alias("share"))


# ---- 6 ---------------------------------------------------------------------


def p6_found(spark, sf_dir):
    paf = top_n.best_records(table(spark, sf_dir, "paf_records"))
    hits = top_n.best_hits(table(spark, sf_dir, "containment_hits"))
    return paf.select(F.lit("paf").alias("kind"), "query_name", "rec_id").unionByName(
        hits.select(F.lit("hit").alias("kind"), "query_name", F.col("hit_id").alias("rec_id"))
    )


def p6_ranked(spark, sf_dir):
    paf = top_n.best_records(table(spark, sf_dir, "paf_records"), rank_as="rank")
    hits = top_n.best_hits(table(spark, sf_dir, "containment_hits"), rank_as="rank")
    return paf.select(
        F.lit("paf").alias("kind"), "query_name", "rank", F.col("num_matches").cast("double").alias("score"), "rec_id"
    ).unionByName(
        hits.select(F.lit("hit").alias("kind"), "query_name", "rank", F.col("containment").alias("score"), F.col("hit_id").alias("rec_id"))
    )


# ---- 7 ---------------------------------------------------------------------


def p7_ids(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


# ---- 8 ---------------------------------------------------------------------


def p8_pack(spark, sf_dir):
    return packing.pack_corpus(table(spark, sf_dir, "documents"))


def p8_use(spark, sf_dir):
    return packing.container_use(packing.pack_corpus(table(spark, sf_dir, "documents")))


# ---- 9 ---------------------------------------------------------------------


def _quality(spark, sf_dir):
    return text_quality.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark, sf_dir):
    return _quality(spark, sf_dir).where("is_junk").select("doc_id")


def p9_stats(spark, sf_dir):
    return _quality(spark, sf_dir)


QUERIES = [
    p2_found, p2_scores, p2_unitig_idf, p3_found, p3_classes, p4_found, p4_species, p4_periods, p5_found, p5_shares,
    p6_found, p6_ranked, p7_ids, p7_counts, p8_pack, p8_use, p9_found, p9_stats,
]

_USABLE = r"""
usable AS (
  SELECT min(rec_id) AS rec_id, query_name, target_name, num_matches, alignment_len, run_day
  FROM paf_records
  WHERE query_name IS NOT NULL AND num_matches IS NOT NULL AND alignment_len > 0 AND num_matches BETWEEN 0 AND alignment_len
  GROUP BY query_name, query_len, query_start, query_end, strand, target_name, target_len, target_start, target_end,
           num_matches, alignment_len, mapq, tags, run_day
), stemmed AS (
  SELECT *, num_matches / alignment_len AS identity, regexp_replace(target_name, '\.(fa|fasta|fna)$', '') AS stem FROM usable
), recs AS (
  SELECT *, CASE WHEN contains(stem, '_') THEN split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2)
                 WHEN contains(stem, '.') THEN split_part(stem, '.', 1) || '_' || split_part(stem, '.', 2)
                 ELSE stem END AS species FROM stemmed
)"""

_MEMBERS = """
m AS (
  SELECT DISTINCT query_name, unitig_id, unnest(genome_ids) AS genome_id
  FROM subgraph_nodes WHERE query_name IS NOT NULL AND unitig_id IS NOT NULL
), sizes AS (
  SELECT query_name, count(DISTINCT unitig_id) AS n_unitigs FROM subgraph_nodes
  WHERE query_name IS NOT NULL AND unitig_id IS NOT NULL GROUP BY query_name
), t AS (SELECT * FROM m WHERE genome_id IS NOT NULL),
ins AS (SELECT query_name, genome_id, count(*) AS n_in FROM t GROUP BY ALL),
recs AS (SELECT genome_id, count(*) AS n_records FROM ins GROUP BY ALL)"""


def _jaccard(kind, sets):
    return f"""
SELECT '{kind}' AS kind, CAST(id_a AS INTEGER) AS id_a, CAST(id_b AS INTEGER) AS id_b FROM (
  WITH e AS ({sets}), s AS (SELECT id, count(*) AS n FROM e GROUP BY id HAVING count(*) >= 5),
  p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM e x JOIN e y ON x.token = y.token AND x.id < y.id
        JOIN s a ON a.id = x.id JOIN s b ON b.id = y.id AND b.n >= 0.79 * a.n AND a.n >= 0.79 * b.n GROUP BY ALL)
  SELECT id_a, id_b FROM p JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE 10 * c >= 8 * (a.n + b.n - c))"""


_SPANS = """
WITH recs AS (
  SELECT 'sequence' AS kind, CAST(seq_id AS BIGINT) AS id, max_by(upper(coalesce(seq, '')), (length(coalesce(seq, '')), upper(coalesce(seq, '')))) AS txt
  FROM sequences WHERE seq_id IS NOT NULL GROUP BY seq_id
  UNION ALL SELECT 'unitig', CAST(unitig_id AS BIGINT), max_by(upper(coalesce(sequence, '')), (length(coalesce(sequence, '')), upper(coalesce(sequence, ''))))
  FROM unitigs WHERE unitig_id IS NOT NULL GROUP BY unitig_id
), w AS (
  SELECT kind, id, pos, substr(txt, CAST(pos + 1 AS BIGINT), 50) AS g FROM (SELECT *, unnest(range(greatest(length(txt) - 49, 0))) AS pos FROM recs)
), ok AS (SELECT * FROM w WHERE NOT regexp_matches(g, '[^ACGT]')),
s AS (SELECT g FROM ok GROUP BY g HAVING count(DISTINCT (kind, id)) > 1),
h AS (SELECT kind, id, pos FROM ok SEMI JOIN s USING (g)),
b AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY kind, id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT *, sum(new) OVER (PARTITION BY kind, id ORDER BY pos) AS run FROM b),
spans AS (SELECT kind, id, min(pos) AS lo, max(pos) AS hi FROM r GROUP BY kind, id, run)"""

SQL = {
    "p2_found": f"""WITH {_MEMBERS}
SELECT query_name, genome_id FROM ins JOIN recs USING (genome_id) JOIN sizes USING (query_name)
WHERE n_unitigs >= 4 AND 2 * n_in >= n_unitigs AND n_records <= 2""",
    "p2_scores": f"""WITH {_MEMBERS},
o AS (SELECT *, row_number() OVER (PARTITION BY query_name, unitig_id ORDER BY genome_id) AS r FROM t),
g AS (SELECT DISTINCT x.query_name, x.genome_id, y.genome_id AS other FROM o x JOIN o y
      ON x.query_name = y.query_name AND x.unitig_id = y.unitig_id AND y.r BETWEEN x.r - 3 AND x.r + 3 AND y.r <> x.r),
d AS (SELECT query_name, genome_id, count(*) AS n_g FROM g GROUP BY ALL)
SELECT query_name, genome_id, n_in + coalesce(n_g, 0) AS degree, n_in, n_unitigs, n_records,
  round((n_in + coalesce(n_g, 0)) * ln((SELECT count(DISTINCT query_name) FROM subgraph_nodes) / n_records), 6) AS score
FROM ins LEFT JOIN d USING (query_name, genome_id) JOIN recs USING (genome_id) JOIN sizes USING (query_name)""",
    "p2_unitig_idf": """
WITH p AS (SELECT DISTINCT unitig_id, g FROM (SELECT unitig_id, unnest(genome_ids) AS g FROM subgraph_nodes) WHERE g IS NOT NULL AND unitig_id IS NOT NULL),
c AS (SELECT unitig_id, count(*) AS n_genomes, (SELECT count(DISTINCT g) FROM p) AS n FROM p GROUP BY unitig_id)
SELECT unitig_id, batch_id, n_genomes, round(ln(n / n_genomes), 5) AS idf, round(log2(n / n_genomes), 5) AS information,
  coalesce(isnan(unitig_idf) OR abs(CAST(unitig_idf AS DOUBLE) - ln(n / n_genomes)) > 0.001, true) AS is_off
FROM kmer_cache JOIN c USING (unitig_id)""",
    "p3_found": _jaccard("path", "SELECT DISTINCT id, token FROM (SELECT genome_id AS id, unnest(steps).unitig_id AS token FROM genome_paths) WHERE token IS NOT NULL")
    + " UNION ALL "
    + _jaccard("node", "SELECT DISTINCT id, token FROM (SELECT unitig_id AS id, unnest(genome_ids) AS token FROM subgraph_nodes) WHERE token IS NOT NULL"),
    "p4_found": f"""WITH {_USABLE},
med AS (SELECT s.summary_id, s.median_identity, median(r.identity) AS m
  FROM species_summary s JOIN recs r ON r.query_name = s.query_name AND r.species = s.species AND r.run_day BETWEEN s.day_from AND s.day_to
  WHERE s.median_identity IS NOT NULL AND NOT isnan(s.median_identity) GROUP BY ALL)
SELECT summary_id FROM med WHERE abs(median_identity - m) > 0.005""",
    "p5_found": f"""{_SPANS}
SELECT kind AS rec_kind, id AS rec_id, CAST(lo AS INTEGER) AS span_start, CAST(hi + 50 AS INTEGER) AS span_end FROM spans""",
    "p5_shares": f"""{_SPANS},
sums AS (SELECT kind, id, count(*) AS n_spans, sum(hi + 50 - lo) AS n FROM spans GROUP BY ALL)
SELECT kind AS rec_kind, id AS rec_id, length(txt) AS n_letters, coalesce(n_spans, 0) AS n_spans, CAST(coalesce(n, 0) AS BIGINT) AS n_shared,
  round(CASE WHEN length(txt) > 0 THEN coalesce(n, 0) / length(txt) ELSE 0 END, 6) AS share FROM recs LEFT JOIN sums USING (kind, id)""",
    "p6_found": f"""WITH {_USABLE},
a AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY num_matches DESC, alignment_len, rec_id) AS rn FROM recs),
h AS (SELECT *, row_number() OVER (PARTITION BY query_name, genome_id ORDER BY containment DESC, hit_id) AS one FROM containment_hits
  WHERE query_name IS NOT NULL AND containment IS NOT NULL AND NOT isnan(containment) AND containment BETWEEN 0 AND 1),
b AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY containment DESC, genome_id) AS rn FROM h WHERE one = 1)
SELECT 'paf' AS kind, query_name, rec_id FROM a WHERE rn <= 5
UNION ALL SELECT 'hit', query_name, hit_id FROM b WHERE rn <= 5""",
    "p6_ranked": f"""WITH {_USABLE},
a AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY num_matches DESC, alignment_len, rec_id) AS rn FROM recs),
h AS (SELECT *, row_number() OVER (PARTITION BY query_name, genome_id ORDER BY containment DESC, hit_id) AS one FROM containment_hits
  WHERE query_name IS NOT NULL AND containment IS NOT NULL AND NOT isnan(containment) AND containment BETWEEN 0 AND 1),
b AS (SELECT *, row_number() OVER (PARTITION BY query_name ORDER BY containment DESC, genome_id) AS rn FROM h WHERE one = 1)
SELECT 'paf' AS kind, query_name, CAST(rn AS INTEGER) AS rank, CAST(num_matches AS DOUBLE) AS score, rec_id FROM a WHERE rn <= 5
UNION ALL SELECT 'hit', query_name, CAST(rn AS INTEGER), containment, hit_id FROM b WHERE rn <= 5""",
}


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(SQL)
