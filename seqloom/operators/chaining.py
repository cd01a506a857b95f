"""Seeds, anchors and colinear chains; features and training of the seed scorer."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import stats
from seqloom.functions.dna import gc_content
from seqloom.session import merge_join

PAIRWISE_LIMIT: int | None = None  # the original drops the gap cost from 5,000 anchors on; here a number turns that on


def best_chain(qs, qe, rs, re_, score) -> tuple[float, list[int]]:
    """Best chain of anchors sorted by (ref, query) start; scores in thousandths, gap cost 0.01 per gap base
    and 0.5 per difference, for any number of anchors.  Only where ``PAIRWISE_LIMIT`` is set, from that many on:
    without gap cost, by a sorted frontier."""
    n = len(qs)
    own = (score * 1000.0).astype(np.int64)
    dp, parent = own.copy(), np.full(n, -1)
    if PAIRWISE_LIMIT is None or n < PAIRWISE_LIMIT:
        for i in range(1, n):
            ok = np.flatnonzero((qe[:i] <= qs[i]) & (re_[:i] <= rs[i]))
            if len(ok):
                qg, rg = qs[i] - qe[ok], rs[i] - re_[ok]
                total = dp[ok] + own[i] - (0.01 * (qg + rg) + 0.5 * np.abs(qg - rg)).astype(np.int64)
                j = int(total.argmax())
                if total[j] > dp[i]:
                    dp[i], parent[i] = total[j], ok[j]
    else:
        # anchors come in the order of their start, and join a frontier when their end is passed:
        # ends ascending in the query, chain scores ascending
        waiting = sorted(range(n), key=lambda i: re_[i])
        ends: list[int] = []
        heads: list[int] = []
        at = 0
        for i in range(n):
            while at < n and re_[waiting[at]] <= rs[i]:
                a = waiting[at]
                at += 1
                if a >= i:
                    continue
                p = bisect.bisect_right(ends, qe[a])
                if p and dp[heads[p - 1]] >= dp[a]:
                    continue
                while p < len(ends) and dp[heads[p]] <= dp[a]:
                    del ends[p], heads[p]
                ends.insert(p, int(qe[a]))
                heads.insert(p, a)
            p = bisect.bisect_right(ends, qs[i])
            if p and dp[heads[p - 1]] > 0:
                dp[i] += dp[heads[p - 1]]
                parent[i] = heads[p - 1]
    end = n - 1 - int(dp[::-1].argmax())  # the last of equal maxima
    path, i = [], end
    while i >= 0:
        path.append(i)
        i = int(parent[i])
    return float(dp[end]), path[::-1]


def chains(anchors: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Best chain of each query, genome and strand; ``anchors`` (query_name, query_len, genome_id, is_reverse,
    query_start, ref_start, match_len, score).  A group is one query in one genome."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ref_start", "query_start"], kind="stable")
        q, r, m = (pdf[c].to_numpy(np.int64) for c in ("query_start", "ref_start", "match_len"))
        total, path = best_chain(q, q + m, r, r + m, pdf["score"].to_numpy(np.float64))
        matched = int(m[path].sum())
        span = int(q[path[-1]] + m[path[-1]] - q[path[0]])
        qlen = int(pdf["query_len"].iloc[0])
        return pd.DataFrame(
            {
                "query_name": [pdf["query_name"].iloc[0]], "genome_id": [pdf["genome_id"].iloc[0]], "is_reverse": [pdf["is_reverse"].iloc[0]],
                "chain_score": [total], "n_anchors": [len(path)], "matched": [matched],
                "coverage": [matched / (qlen if qlen > 0 else max(span, 1))],
                "query_from": [int(q[path[0]])], "query_to": [int(q[path[-1]] + m[path[-1]])],
                "ref_from": [int(r[path[0]])], "ref_to": [int(r[path[-1]] + m[path[-1]])],
            }
        )

    out = anchors.groupBy("query_name", "genome_id", "is_reverse").applyInPandas(
        run,
        "query_name string, genome_id int, is_reverse boolean, chain_score double, n_anchors int, matched long, coverage double, "
        "query_from long, query_to long, ref_from long, ref_to long",
    )
    return out.where(F.col("chain_score") >= min_score)


def seed_features(seeds: DataFrame, queries: DataFrame, n_genomes: int) -> DataFrame:
    """The ten features of each seed (query_name, pos, match_len, freq, card) and its logistic score."""
    rows = merge_join(seeds, queries.select("query_name", "seq", F.length("seq").alias("_n")), "query_name")
    near = Window.partitionBy("query_name").orderBy("pos").rangeBetween(-500, 500)
    span = F.least(F.col("pos") + 500, F.col("_n")) - F.greatest(F.col("pos") - 500, F.lit(0))
    n, m, f = F.col("_n"), F.col("match_len"), F.col("freq")
    denom = f * F.greatest(F.col("card"), F.lit(1))
    rows = (
        rows.withColumn("log_sa_count", F.when(f > 0, F.log2(f)).otherwise(F.lit(0.0)))
        .withColumn("query_pos_frac", F.when(n > 0, F.col("pos") / n).otherwise(F.lit(0.0)))
        .withColumn("match_frac", F.when(n > 0, m / n).otherwise(F.lit(0.0)))
        .withColumn("color_cardinality", F.col("card").cast("double"))
        .withColumn("gc_content", gc_content(F.substring("seq", F.col("pos") + 1, m)))
        .withColumn("information_content", stats.information_content(float(n_genomes), "card"))
        .withColumn("inverse_sa_count", F.when(f > 0, 1 / f).otherwise(F.lit(0.0)))
        .withColumn("local_seed_density", F.when(span > 0, F.count(F.lit(1)).over(near) / (span / 1000.0)).otherwise(F.lit(0.0)))
        .withColumn("seed_uniqueness", F.when(denom > 0, m / denom).otherwise(F.lit(0.0)))
    )
    return rows.withColumn("score", stats.seed_score()).withColumn("weighted_score", F.col("score") * m).drop("seq", "_n")


def train_seed_scorer(features: DataFrame, label: str = "label") -> list[float]:
    """Eleven weights by class-weighted, L2-regularised logistic regression on all rows labelled 0 or 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = features.where(F.col(label).isin(0, 1)).select(label, *stats.SEED_FEATURES).persist()  # read twice
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        rows.unpersist()
        return list(stats.SEED_WEIGHTS)
    weighted = rows.withColumn("_w", F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0])))
    data = VectorAssembler(inputCols=stats.SEED_FEATURES, outputCol="features").transform(weighted.fillna(0.0, stats.SEED_FEATURES))
    fit = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", regParam=0.01, standardization=True).fit(data)
    rows.unpersist()
    return [float(fit.intercept), *[float(x) for x in fit.coefficients]]


def pigeonhole_anchors(window_len: int, k_anchor: int = 10, n_anchors: int = 3) -> list[int]:
    """Offsets of the anchors of a window."""
    n = min(n_anchors, window_len // k_anchor) if window_len >= k_anchor else 0
    if not n:
        return []
    step = max((window_len - k_anchor) // n, k_anchor)
    return [i * step for i in range(n) if i * step + k_anchor <= window_len]


def text_words(texts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys..., pos, w) of every clean window of ``seq`` as it stands, forward only."""
    rows = texts.where(F.length("seq") >= k).select(*keys, "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("pos"))
    return rows.select(*keys, "pos", F.substring("seq", F.col("pos") + 1, F.lit(k)).alias("w")).where(~F.col("w").rlike("[^ACGT]"))


def window_anchors(queries: DataFrame, windows: DataFrame, window_len: int, k_anchor: int = 10, n_anchors: int = 3, min_window: int | None = None) -> DataFrame:
    """(query_name, pos, query_pos, w): anchors of the windows (query_name, pos).  Empty where the window is
    too short for them."""
    offsets = pigeonhole_anchors(window_len, k_anchor, n_anchors) if window_len >= (min_window or k_anchor * n_anchors) else []
    array = F.array(*[F.lit(o) for o in offsets]) if offsets else F.array().cast("array<int>")
    rows = merge_join(windows, queries, "query_name").select("query_name", "pos", "seq", F.explode(array).alias("_o"))
    at = F.col("pos") + F.col("_o")
    return rows.select("query_name", "pos", at.alias("query_pos"), F.substring("seq", at + 1, F.lit(k_anchor)).alias("w")).where(~F.col("w").rlike("[^ACGT]"))


def anchor_hits(queries: DataFrame, unsolved: DataFrame, words: DataFrame, window_len: int, k_anchor: int = 10, n_anchors: int = 3, max_freq: int = 10_000, min_window: int | None = None) -> DataFrame:
    """Forward anchor hits (query_name, pos, query_pos, genome_id, card) of windows without a solid hit:
    ``unsolved`` (query_name, pos), ``words`` (kmer text column ``w`` of ``k_anchor`` letters with genome_id);
    ``card`` is the number of genomes that hold the anchor."""
    a = window_anchors(queries, unsolved, window_len, k_anchor, n_anchors, min_window)
    pairs = merge_join(words, a.select("w").distinct(), "w", "left_semi").groupBy("w", "genome_id").agg(F.count(F.lit(1)).alias("_n"))
    freq = pairs.groupBy("w").agg(F.sum("_n").alias("_f"), F.count(F.lit(1)).alias("card")).where(F.col("_f") <= max_freq)
    return merge_join(a, merge_join(pairs, freq, "w").select("w", "genome_id", "card"), "w").select("query_name", "pos", "query_pos", "genome_id", "card")
