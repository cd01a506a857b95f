import numpy as np

from seqloom.functions import stats
from seqloom.operators import chaining


def test_gap_cost_holds_for_many_anchors():
    # 5,001 anchors on one diagonal, and one a million letters off it that isn't worth its gap
    q = np.arange(5_002) * 10
    r = q.copy()
    r[-1] += 1_000_000
    m = np.full(len(q), 5)
    total, path = chaining.best_chain(q, q + m, r, r + m, m.astype(float))
    assert total == 5_001 * 5_000 and len(path) == 5_001


def test_scorer_fits_all_rows(spark):
    # every row 300 times over has the weights of every row 400 times over; samples of them differ
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1_000, len(stats.SEED_FEATURES)))
    rows = [(int(a[:3].sum() + rng.normal() > 0), *map(float, a)) for a in x]
    once = spark.createDataFrame(rows, ["label", *stats.SEED_FEATURES])
    a, b = (chaining.train_seed_scorer(once.crossJoin(spark.range(n).drop("id"))) for n in (300, 400))
    assert np.allclose(a, b, rtol=0, atol=1e-4)
