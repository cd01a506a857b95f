"""Scores and probabilities of matches as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz and Stegun 7.1.26 error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Karlin-Altschul parameters and match scores of the tabular output.
LAMBDA, KAPPA = 1.374, 0.711
MATCH_SCORE, MISMATCH_PENALTY = 1, 2

# Bias and weights of the ten seed features.
SEED_FEATURES = [
    "match_len", "log_sa_count", "query_pos_frac", "match_frac", "color_cardinality", "gc_content",
    "information_content", "inverse_sa_count", "local_seed_density", "seed_uniqueness",
]
SEED_WEIGHTS = [0.5, 0.15, -0.3, 0.0, 0.1, -0.2, -0.05, 0.3, 0.1, 0.05, 0.2]


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def information_content(total: Column | float, card: Column | str) -> Column:
    """log2(total / card); 0 if either is 0."""
    n, c = _c(total), _c(card)
    return F.when((n > 0) & (c > 0), F.log2(n / c)).otherwise(F.lit(0.0))


def idf(total: Column | float, card: Column | str) -> Column:
    """ln(total / max(card, 1)), at least 0."""
    return F.greatest(F.log(_c(total) / F.greatest(_c(card), F.lit(1))), F.lit(0.0))


def erf(x: Column) -> Column:
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x + F.lit(1e-300)) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return F.least(F.greatest((1 + erf(z / math.sqrt(2))) / 2, F.lit(0.0)), F.lit(1.0))


def match_probability(hits: Column | str, total: Column | str, threshold: float) -> Column:
    """Posterior chance that the true containment reaches ``threshold``: uniform prior, normal tail.  Null without samples."""
    n, m = _c(hits) + 1.0, _c(total) + 2.0
    mu = n / m
    sd = F.sqrt(mu * (1 - mu) / m)
    return F.when(_c(total) > 0, F.when(sd > 0, normal_cdf((mu - threshold) / sd)).otherwise((mu >= threshold).cast("double")))


def posterior_ani(hits: Column | str, total: Column | str, k: int) -> Column:
    return F.when(_c(total) > 0, F.pow((_c(hits) + 1.0) / (_c(total) + 2.0), F.lit(1.0 / k)))


def ani_interval(hits: Column | str, total: Column | str, k: int) -> Column:
    """Half width of the 95 % interval of ANI by the delta method, at most 0.5; null without samples or hits."""
    s, n = _c(hits).cast("double"), _c(total).cast("double")
    c = s / n
    ani = F.pow(c, F.lit(1.0 / k))
    se = F.sqrt(c * (1 - c) / n) / (F.lit(float(k)) * F.pow(ani, F.lit(float(k - 1))))
    return F.when((n > 0) & (s > 0), F.least(1.96 * se, F.lit(0.5)))


def _largest_k(length: Column | str, least: int, most: int, need: float, rate: float) -> Column:
    n = _c(length)
    enough = F.filter(
        F.sequence(F.lit(least), F.lit(max(most, least))),
        lambda k: (n >= k) & ((n - k + 1) * F.pow(F.lit(rate), k.cast("double")) >= need),
    )
    return F.coalesce(F.array_max(enough), F.lit(least))


def adaptive_k(length: Column | str, max_k: int = 31) -> Column:
    """Largest k from 15 to max_k that leaves 50 expected intact k-mers at 5 % divergence, else 15."""
    return _largest_k(length, 15, max_k, 50.0, 0.95)


def adaptive_k_cross_species(length: Column | str, max_k: int = 31) -> Column:
    """The same from 7, with 30 intact k-mers at 15 % divergence."""
    return _largest_k(length, 7, max_k, 30.0, 0.85)


def fallback_ks(k: int, least: int = 15, step: int = 4) -> list[int]:
    """k, k - 4, ... down to ``least``."""
    ks = list(range(k, least, -step))
    return [*ks, least] if k > least else [k]


def sensitivity_gain(old_k: int, new_k: int, identity: float = 0.95) -> float:
    return identity ** (new_k - old_k)


def anchor_sensitivity(divergence: Column | float, k: int, anchors: int, votes: int) -> Column:
    """Chance that at least ``votes`` of ``anchors`` k-mers stay intact."""
    p = F.pow(1 - _c(divergence), F.lit(float(k)))
    out = F.lit(0.0)
    for i in range(votes, anchors + 1):
        out = out + F.lit(float(math.comb(anchors, i))) * F.pow(p, F.lit(float(i))) * F.pow(1 - p, F.lit(float(anchors - i)))
    return out


def bit_score(matches: Column | str, mismatches: Column | str) -> Column:
    raw = MATCH_SCORE * _c(matches) - MISMATCH_PENALTY * _c(mismatches)
    return F.when(raw > 0, (F.lit(LAMBDA) * raw - F.lit(math.log(KAPPA))) / F.lit(math.log(2))).otherwise(F.lit(0.0))


def e_value(matches: Column | str, mismatches: Column | str, query_len: Column | str, database_len: Column | float) -> Column:
    raw = MATCH_SCORE * _c(matches) - MISMATCH_PENALTY * _c(mismatches)
    space = F.greatest(_c(query_len), F.lit(1)).cast("double") * F.greatest(_c(database_len), F.lit(1)).cast("double")
    return F.when(raw > 0, space * F.pow(F.lit(2.0), -bit_score(matches, mismatches))).otherwise(F.lit(float("inf")))


def seed_score(weights: list[float] | None = None) -> Column:
    """Logistic score of columns named as ``SEED_FEATURES``."""
    w = weights or SEED_WEIGHTS
    z = F.lit(w[0])
    for name, x in zip(SEED_FEATURES, w[1:]):
        z = z + F.lit(x) * F.col(name)
    return 1 / (1 + F.exp(-z))


def load_seed_weights(values: list[float]) -> list[float]:
    """Eleven weights as they are; seven (an older layout) replace the first seven; others: the defaults."""
    if len(values) == len(SEED_WEIGHTS):
        return [float(v) for v in values]
    if len(values) == 7:
        return [float(v) for v in values] + SEED_WEIGHTS[7:]
    return list(SEED_WEIGHTS)


def sprt_steps(p0: float = 1e-6, p1: float = 0.98**31, alpha: float = 0.05, beta: float = 0.05) -> dict[str, float]:
    """Thresholds and steps of the sequential ratio test on k-mer hits."""
    if not (0 < p0 < p1 < 1 and 0 < alpha < 0.5 and 0 < beta < 0.5):
        raise ValueError("need 0 < p0 < p1 < 1 and error rates in (0, 0.5)")
    return {
        "low": math.log(beta / (1 - alpha)),
        "high": math.log((1 - beta) / alpha),
        "hit": math.log(p1 / p0),
        "miss": math.log((1 - p1) / (1 - p0)),
    }
