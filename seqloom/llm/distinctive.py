"""How distinctive a genome is of a query's subgraph: graph-of-words weighting.

The record of a query is the set of its unitigs; its text is, unitig by unitig,
the unitig and then its genomes in ascending order.  A window holds the unitig it
stands under and ``window`` consecutive genomes.  Terms that share a window are
neighbours; a genome's weight in a record is its number of distinct neighbours
(unitigs and genomes) instead of a frequency, and the score is that degree times
the rarity ln(records / records with the genome).  Information content is
recomputed from all rows of a unitig, never read from stored columns.

Each edge is kept once, from the lesser genome to the greater, so edges grow with
(window - 1) x tokens, not with pairs, and the graph of a record is one shuffle.  Hot
genomes and hot queries are met by keys (query, unitig), (query, edge), (query, genome)
and by salted lookups.

Defined results of edge cases
* null query_name, null unitig_id: no record, no part of one; null genome ids: left out
* null or empty genome_ids: the unitig counts in the record, gives no term
* repeated rows, repeated ids, stale shorter lists: sets are united
* other columns are not read, so clashing names do no harm
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import salted_lookup

WINDOW = 4


def records_of(nodes: DataFrame) -> DataFrame:
    """(query_name, unitig_id, genomes): one row per unitig of a record, its genomes ascending.  A list
    is at most as long as the collection has genomes; repeats are combined before the shuffle."""
    return (
        nodes.where(F.col("query_name").isNotNull() & F.col("unitig_id").isNotNull())
        .select("query_name", "unitig_id", F.explode("genome_ids").alias("genome_id"))
        .where(F.col("genome_id").isNotNull())
        .groupBy("query_name", "unitig_id")
        .agg(F.array_sort(F.collect_set("genome_id")).alias("genomes"))
    )


def cooccurrence_edges(records: DataFrame, window: int = WINDOW) -> DataFrame:
    """(query_name, low, high, times): pairs of genomes that share a window, low < high, and how many
    unitigs they share one under; with ``high`` null the unitigs that ``low`` stands under itself."""
    each = records.select("query_name", "genomes", F.posexplode("genomes").alias("_at", "low"))
    near = [F.get("genomes", F.col("_at") + d) for d in range(1, window)]
    own = F.struct(F.lit(True).alias("own"), F.lit(None).cast("int").alias("high"))
    ends = F.array(own, *[F.struct(F.lit(False).alias("own"), n.cast("int").alias("high")) for n in near])
    rows = each.select("query_name", "low", F.explode(ends).alias("_e")).where("_e.own OR _e.high IS NOT NULL")
    return rows.groupBy("query_name", "low", F.col("_e.high").alias("high")).agg(F.count(F.lit(1)).alias("times"))


def unitig_information(nodes: DataFrame) -> DataFrame:
    """(unitig_id, n_genomes, n_collection, information, idf) from all rows of each unitig:
    log2 and natural logarithm of the collection's genomes over the unitig's."""
    pairs = (
        nodes.where(F.col("unitig_id").isNotNull())
        .select("unitig_id", F.explode("genome_ids").alias("genome_id"))
        .where(F.col("genome_id").isNotNull())
        .distinct()
    )
    total = pairs.agg(F.count_distinct("genome_id").alias("n")).first()[0]
    card = pairs.groupBy("unitig_id").agg(F.count(F.lit(1)).alias("n_genomes"))
    share = F.lit(float(total)) / F.col("n_genomes")
    return card.withColumn("n_collection", F.lit(int(total)).cast("long")).withColumn("information", F.log2(share)).withColumn(
        "idf", F.log(share)
    )


def distinctive_terms(nodes: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per query and genome: ``degree`` (distinct neighbours), ``n_in`` (unitigs it stands in),
    ``n_unitigs`` (of the record), ``n_records`` (with the genome), ``n_collection`` (records), ``rarity``
    and ``score``."""
    edges = cooccurrence_edges(records_of(nodes), window)
    node = lambda g, n_in, n_g: F.struct(F.col(g).alias("genome_id"), n_in.alias("u"), n_g.alias("g"))
    none, one, alone = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("high").isNull()
    low = node("low", F.when(alone, F.col("times")).otherwise(none), F.when(alone, none).otherwise(one))
    degrees = (
        edges.select("query_name", F.explode(F.array(low, node("high", none, one))).alias("_n"))
        .where(F.col("_n.genome_id").isNotNull())
        .groupBy("query_name", F.col("_n.genome_id").alias("genome_id"))
        .agg((F.sum("_n.u") + F.sum("_n.g")).alias("degree"), F.sum("_n.u").alias("n_in"))
    )
    # record sizes: two columns of the rows themselves, combined before each shuffle
    named = nodes.where(F.col("query_name").isNotNull())
    sizes = named.where(F.col("unitig_id").isNotNull()).select("query_name", "unitig_id").distinct()
    sizes = sizes.groupBy("query_name").agg(F.count(F.lit(1)).alias("n_unitigs"))
    total = named.agg(F.greatest(F.count_distinct("query_name"), F.lit(1)).alias("n")).scalar()
    spread = degrees.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n_records"))
    out = salted_lookup(degrees, spread, "genome_id", F.col("query_name"))
    out = salted_lookup(out, sizes, "query_name", F.col("genome_id")).withColumn("n_collection", total)
    rarity = F.log(F.col("n_collection") / F.col("n_records"))
    return out.withColumn("rarity", rarity).withColumn("score", F.col("degree") * F.col("rarity"))


def high_scores(scored: DataFrame, most_records: int) -> DataFrame:
    """Rows whose score reaches what any genome scores that stands in half of its record and in at most
    ``most_records`` records: its degree counts each of its unitigs, so it is at least half of the
    record's, and its rarity is at least ln(records / most_records)."""
    half = F.ceil(F.col("n_unitigs") / 2)
    rare = F.greatest(F.log(F.col("n_collection") / F.lit(float(most_records))), F.lit(0.0))
    return scored.where(F.col("score") >= half * rare - F.lit(1e-9))


def marking_genomes(nodes: DataFrame, least_unitigs: int = 4, most_records: int = 2, window: int = WINDOW) -> DataFrame:
    """Genomes in at least half of a record's unitigs and in at most ``most_records`` records: those of
    high score, of which the exact counts are then checked."""
    return high_scores(distinctive_terms(nodes, window), most_records).where(
        (F.col("n_unitigs") >= least_unitigs)
        & (2 * F.col("n_in") >= F.col("n_unitigs"))
        & (F.col("n_records") <= most_records)
    )
