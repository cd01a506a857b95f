"""Variable-length seeds and lookups by position, as equi-joins.

The longest exact match from a query position is the run of consecutive k-mer hits
on one diagonal that begins there: gaps and islands over an equi-join on the least
length give what a suffix structure gives, for any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.dna import explode_kmers
from seqloom.session import merge_join


def maximal_matches(queries: DataFrame, targets: DataFrame, min_len: int, max_freq: int = 10_000) -> DataFrame:
    """(query_name, unitig_id, is_reverse, query_pos, unitig_offset, match_len) of exact matches of at least
    ``min_len`` <= 31 letters that can't be made longer, both strands; words that occur more than
    ``max_freq`` times begin none."""
    q = explode_kmers(queries, ["query_name"], "seq", min_len).withColumnRenamed("pos", "qpos").withColumnRenamed("is_rc", "_q")
    t = merge_join(explode_kmers(targets, ["unitig_id"], "seq", min_len), q.select("kmer").distinct(), "kmer", "left_semi")
    freq = t.groupBy("kmer").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") <= max_freq).select("kmer")
    hits = merge_join(q, merge_join(t, freq, "kmer", "left_semi"), "kmer").withColumn("is_reverse", F.col("_q") != F.col("is_rc"))
    # forward: offset - pos is constant on a diagonal; reverse: offset + pos
    diag = F.when(F.col("is_reverse"), F.col("pos") + F.col("qpos")).otherwise(F.col("pos") - F.col("qpos"))
    hits = hits.withColumn("_d", diag)
    w = Window.partitionBy("query_name", "unitig_id", "is_reverse", "_d").orderBy("qpos")
    runs = hits.withColumn("_run", F.col("qpos") - F.row_number().over(w))
    return runs.groupBy("query_name", "unitig_id", "is_reverse", "_d", "_run").agg(
        F.min("qpos").alias("query_pos"), F.min("pos").alias("unitig_offset"), (F.count(F.lit(1)) + min_len - 1).cast("int").alias("match_len")
    ).drop("_d", "_run")


def longest_match(matches: DataFrame, min_len: int) -> DataFrame:
    """(query_name, query_pos, match_len, n_places): of each position that begins a match, the longest one and
    in how many places it stands."""
    at = matches.select(
        "query_name", "unitig_id",
        F.explode(F.sequence(F.col("query_pos"), F.col("query_pos") + F.col("match_len") - min_len)).alias("p"),
        (F.col("query_pos") + F.col("match_len")).alias("_end"),
    )
    per = at.groupBy("query_name", "p", (F.col("_end") - F.col("p")).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("query_name", "p").agg(F.max(F.struct("len", "n")).alias("m"))
    return best.select("query_name", F.col("p").alias("query_pos"), F.col("m.len").cast("int").alias("match_len"), F.col("m.n").alias("n_places"))


def text_starts(unitigs: DataFrame) -> DataFrame:
    """(unitig_id, start, len) in the text of all unitigs on end with one separator each.  Offsets of blocks of
    ids are summed first, so no task sees all unitigs."""
    block = F.floor(F.col("unitig_id") / 4096)
    rows = unitigs.select("unitig_id", F.length("seq").cast("long").alias("len"), block.alias("_b"))
    sums = rows.groupBy("_b").agg(F.sum(F.col("len") + 1).alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_o"))  # a row for 4,096 ids
    w = Window.partitionBy("_b").orderBy("unitig_id")
    return rows.join(before, "_b").select("unitig_id", (F.col("_o") + F.sum(F.col("len") + 1).over(w) - F.col("len") - 1).alias("start"), "len")


def position_to_unitig(positions: DataFrame, starts: DataFrame, width: int = 4096) -> DataFrame:
    """(pos, unitig_id, offset): null on separators and beyond the end.  A range join as an equi-join over
    bins of ``width`` letters."""
    binned = starts.select("*", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("len")) / width))).alias("_bin"))
    p = positions.select("pos", F.floor(F.col("pos") / width).alias("_bin"))
    inside = (F.col("p.pos") >= F.col("s.start")) & (F.col("p.pos") < F.col("s.start") + F.col("s.len"))
    out = p.alias("p").join(binned.alias("s"), (F.col("p._bin") == F.col("s._bin")) & inside, "left")
    return out.select("p.pos", "s.unitig_id", (F.col("p.pos") - F.col("s.start")).alias("offset"))
