"""Percentiles of very large numeric columns by merging centroid digests.

A digest of a group is a set of rows (centroid mean, weight, least and largest
member).  ``digest`` clusters the sorted values of each part under a size
function that narrows towards both ends (k(q) = delta / (2 pi) * asin(2q - 1));
``merge`` re-clusters the centroids of parts (days, partitions, earlier runs)
under the same function; ``estimate`` reads quantiles; ``brackets`` gives for a
rank two values between which the exact order statistic must lie, from the
members' least and largest values; ``certify`` counts in a second pass over the
data how many values lie below and up to an estimate, which is its exact rank
error; ``exact_ranks`` selects the order statistics inside the brackets.

All of it is window functions and aggregates in the JVM.  A hot group is spread
by day and by salts of its measured size when digested, so a task sorts a bounded
number of values; beyond that only centroids travel.  A merge sees at most about
delta / 2 centroids a part.

Defined results of edge cases
* null and NaN values: left out; a group without values: no digest
* equal values: may share a centroid, brackets and counts stay exact
* groups of up to about delta / pi values: every value its own centroid, so exact
* null group keys: a group of their own
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA = 200.0


def _cluster(q: Column, delta: float) -> Column:
    arg = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * q - 1))
    return F.floor(F.lit(delta / (2 * math.pi)) * F.asin(arg) + F.lit(delta / 4))


def _dense(w_mid: Column, total: Column, delta: float) -> Column:
    return _cluster(w_mid / total, delta)


def digest(values: DataFrame, keys: list[str], parts: list[str], value: str, delta: float = DELTA) -> DataFrame:
    """Centroids of every (keys, parts): ``mean``, ``weight``, ``vmin``, ``vmax``."""
    by = [*keys, *parts]
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *by, F.col(value).cast("double").alias("_v")
    )
    order = Window.partitionBy(*by).orderBy("_v")
    whole = Window.partitionBy(*by)
    ranked = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole))
    return (
        ranked.withColumn("_c", _cluster((F.col("_r") - 0.5) / F.col("_n"), delta))
        .groupBy(*by, "_c")
        .agg(
            F.avg("_v").alias("mean"),
            F.count(F.lit(1)).cast("double").alias("weight"),
            F.min("_v").alias("vmin"),
            F.max("_v").alias("vmax"),
        )
        .drop("_c")
    )


def merge(digests: DataFrame, keys: list[str], delta: float = DELTA) -> DataFrame:
    """One digest of each ``keys`` out of the digests of its parts, by re-clustering."""
    order = Window.partitionBy(*keys).orderBy("mean", "vmin", "vmax").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = digests.withColumn("_cum", F.sum("weight").over(order)).withColumn("_n", F.sum("weight").over(whole))
    mid = F.col("_cum") - F.col("weight") / 2
    return (
        rows.withColumn("_c", _dense(mid, F.col("_n"), delta))
        .groupBy(*keys, "_c")
        .agg(
            (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"),
            F.sum("weight").alias("weight"),
            F.min("vmin").alias("vmin"),
            F.max("vmax").alias("vmax"),
        )
        .drop("_c")
    )


def estimate(merged: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Rows (keys, quantile, n, estimate).  A rank between two centroids is interpolated
    between their means; below the first and above the last the extreme value stands."""
    by = Window.partitionBy(*keys).orderBy("mean", "vmin", "vmax")
    rows = (
        merged.withColumn("_cum", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("weight").over(Window.partitionBy(*keys)))
        .withColumn("_mid", F.col("_cum") - F.col("weight") / 2)
        .withColumn("_pm", F.lag("_mid").over(by))
        .withColumn("_pv", F.lag("mean").over(by))
        .withColumn("_last", F.lead("mean").over(by).isNull())
        .withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
        .withColumn("_t", F.col("quantile") * F.col("_n"))
    )
    t, mid, pm = F.col("_t"), F.col("_mid"), F.col("_pm")
    inside = F.col("_pv") + (F.col("mean") - F.col("_pv")) * (t - pm) / (mid - pm)
    here = (
        F.when(pm.isNull() & (t <= mid), F.when(F.col("weight") > 1, F.col("vmin") + (F.col("mean") - F.col("vmin")) * t / mid).otherwise(F.col("mean")))
        .when((t > pm) & (t <= mid), inside)
        .when(F.col("_last") & (t > mid), F.when(F.col("weight") > 1, F.col("mean") + (F.col("vmax") - F.col("mean")) * (t - mid) / (F.col("_n") - mid)).otherwise(F.col("mean")))
    )
    return (
        rows.withColumn("_e", here)
        .groupBy(*keys, "quantile")
        .agg(F.max("_n").cast("long").alias("n"), F.max("_e").alias("estimate"))
    )


def brackets(digests: DataFrame, keys: list[str], low_rank: Column, high_rank: Column) -> DataFrame:
    """(keys, n, lo, hi): the order statistics from ``low_rank`` to ``high_rank`` (1-based, may use
    the column ``n``) lie in [lo, hi] for certain.

    The number of values up to v is at most the weight of centroids with vmin <= v and at least
    that of those with vmax <= v.
    """
    up = Window.partitionBy(*keys).orderBy("vmin").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("vmax").rangeBetween(Window.unboundedPreceding, 0)
    rows = (
        digests.withColumn("n", F.sum("weight").over(Window.partitionBy(*keys)).cast("long"))
        .withColumn("_most", F.sum("weight").over(up))
        .withColumn("_least", F.sum("weight").over(down))
    )
    return rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("_most") >= low_rank, F.col("vmin"))).alias("lo"),
        F.min(F.when(F.col("_least") >= high_rank, F.col("vmax"))).alias("hi"),
    )


def certify(values: DataFrame, keys: list[str], value: str, estimates: DataFrame) -> DataFrame:
    """Second pass: ``estimates`` (keys, quantile, n, estimate) with the exact number of values
    below and up to each estimate and ``rank_error``, the certified distance of the wanted rank
    from the ranks at which the estimate stands, as a share of n.

    The estimates of a key are gathered into one array (as many as quantiles), so the data are
    read once, each value meets one row, and counts are combined before the shuffle.
    """
    per = estimates.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("quantile", "estimate"))).alias("_q")
    )
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    # values are combined per distinct value first: ties and repeats leave each task as one row
    seen = rows.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    on = _all([F.col(f"_s.{k}").eqNullSafe(F.col(f"_p.{k}")) for k in keys])
    joined = seen.alias("_s").join(per.alias("_p"), on).select(
        *[F.col(f"_p.{k}").alias(k) for k in keys], "n", "_v", "_m", F.explode("_q").alias("_e")
    )
    counted = joined.groupBy(*keys, F.col("_e.quantile").alias("quantile"), F.col("_e.estimate").alias("estimate"), "n").agg(
        F.sum(F.when(F.col("_v") < F.col("_e.estimate"), F.col("_m")).otherwise(0)).alias("n_below"),
        F.sum(F.when(F.col("_v") <= F.col("_e.estimate"), F.col("_m")).otherwise(0)).alias("n_up_to"),
    )
    want = F.col("quantile") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("n_below") - want, want - F.col("n_up_to")) / F.col("n")
    return counted.withColumn("rank_error", error)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def settle(stated: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Adds ``off`` to rows with a stated ``value`` beside the certain bounds ``lo`` and ``hi`` of the true one:
    whether they differ by more than ``tolerance``, null where the bounds leave it open."""
    v, lo, hi = F.col(value), F.col("lo"), F.col("hi")
    beyond = (v - hi > tolerance) | (lo - v > tolerance)
    within = (F.abs(v - lo) <= tolerance) & (F.abs(v - hi) <= tolerance)
    return stated.withColumn("off", F.when(lo == hi, F.abs(v - lo) > tolerance).when(beyond, True).when(within, False))


def exact_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact medians of each key.  ``rows`` are values beside ``n``, ``lo``, ``hi`` of their key (from
    ``brackets``): values below lo are counted, only those inside [lo, hi] are ranked."""
    v = F.col(value)
    rows = rows.where(v <= F.col("hi")).select(*keys, "n", v.alias("_v"), (v < F.col("lo")).alias("_b"))
    # equal values are combined before they are ranked
    seen = rows.groupBy(*keys, "n", F.when(~F.col("_b"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    cum = seen.withColumn("_cum", F.sum("_m").over(order))
    first = F.floor((F.col("n") + 1) / 2)
    second = F.floor(F.col("n") / 2) + 1
    return (
        cum.groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.min(F.when(F.col("_cum") >= first, F.col("_v"))).alias("_x"),
            F.min(F.when(F.col("_cum") >= second, F.col("_v"))).alias("_y"),
        )
        .select(*keys, "n", ((F.col("_x") + F.col("_y")) / 2).alias("median"))
    )
