"""Top N items within every group by two-stage salted ranking.

Groups are counted first.  Stage 1 hashes every group of more than ``skew.LEAST`` rows
into as many subgroups as its size asks for and keeps N in each; stage 2 ranks the
survivors (at most N a subgroup).  Before either shuffle Spark drops what is beyond rank
N within a task already.  So a group of any size is spread over tasks in proportion to
its rows, and only survivors reach the task of their group.

Defined results of edge cases
* ties: broken by the further order columns, which must end in a unique identifier
* null in an order column: last in either direction; NaN: as the largest value (Spark's order)
* null group: a group of its own; n <= 0: no rows; empty table: no rows
* rows equal in every order column: any N of them, each row counted by itself
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.skew import Spread


def top_n(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    spread: Spread | None = None,
    spread_by: Column | None = None,
    rank_as: str | None = None,
) -> DataFrame:
    """``spread``: measured group sizes, where at hand; ``spread_by`` (default: all columns) is hashed into
    the subgroups of large groups."""
    if spread is None:
        spread = Spread.measure(df, group)
    if spread_by is None:
        spread_by = F.concat_ws("\x01", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns])
    far = Window.partitionBy(*group).orderBy(*order)
    if spread.hot is None:
        kept = df
    else:
        near = Window.partitionBy(*group, "_salt").orderBy(*order)
        kept = spread.facts(df, spread_by).withColumn("_tn_rank", F.row_number().over(near)).where(F.col("_tn_rank") <= n).drop("_salt")
    out = kept.withColumn("_tn_rank", F.row_number().over(far)).where(F.col("_tn_rank") <= n)
    return out.withColumnRenamed("_tn_rank", rank_as) if rank_as else out.drop("_tn_rank")


def best_records(paf: DataFrame, n: int = 5, rank_as: str | None = None) -> DataFrame:
    """The n first usable records of each query by num_matches descending, alignment_len, rec_id."""
    from seqloom.llm.records import usable_records

    order = [F.desc_nulls_last("num_matches"), F.asc_nulls_last("alignment_len"), F.asc_nulls_last("rec_id")]
    rows = usable_records(paf).select("rec_id", "query_name", "num_matches", "alignment_len")
    return top_n(rows, ["query_name"], order, n, Spread.measure(paf, ["query_name"]), F.col("rec_id"), rank_as)


def best_hits(hits: DataFrame, n: int = 5, rank_as: str | None = None) -> DataFrame:
    """The n first genomes of each query by containment descending, genome_id; of each query and
    genome the hit with the highest containment, then the smallest hit_id."""
    c = F.col("containment")
    ok = F.col("query_name").isNotNull() & c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    rows = hits.where(ok).select("query_name", "genome_id", (c + F.lit(0.0)).alias("containment"), "hit_id")
    # least (-containment, hit_id): map-side combined, so several hits of one genome leave each task as one row
    best = (
        rows.groupBy("query_name", "genome_id")
        .agg(F.min(F.struct((-F.col("containment")).alias("neg"), F.col("hit_id").isNull().alias("none"), "hit_id")).alias("_b"))
        .select("query_name", "genome_id", (-F.col("_b.neg") + F.lit(0.0)).alias("containment"), F.col("_b.hit_id").alias("hit_id"))
    )
    order = [F.desc_nulls_last("containment"), F.asc_nulls_last("genome_id")]
    return top_n(best, ["query_name"], order, n, Spread.measure(hits, ["query_name"]), F.col("genome_id"), rank_as)
