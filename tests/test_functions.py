import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom import config
from seqloom.functions import cigar, dna, stats
from seqloom.functions.names import species_of
from seqloom.operators import alignment, chaining, signals


def col(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def packed(s):
    return sum("ACGT".index(c) << (2 * i) for i, c in enumerate(s))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTNacgt", max_size=40), max_size=6), st.integers(1, 31), st.integers(5, 60))
def test_kmers_equal_brute_force(texts, k, chunk):
    got = [(int(r), int(p), int(w), bool(f)) for a in dna.kmers_of(pa.array(texts, pa.string()), k, chunk) for r, p, w, f in zip(*a)]
    want = []
    for i, t in enumerate(texts):
        t = t.upper()
        for p in range(len(t) - k + 1):
            g = t[p : p + k]
            if "N" not in g:
                a, b = packed(g), packed(rc(g))
                want.append((i, p, min(a, b), b < a))
    assert got == want


def test_text_functions(spark):
    assert col(spark, dna.reverse_complement("s"), s="ACGTN") == "NACGT"
    assert col(spark, dna.reverse_complement("s", True), s="ACRT") == "ANGT"
    assert col(spark, dna.gc_content("s"), s="") == 0.5
    assert col(spark, dna.index_to_kmer(F.lit(7), 3)) == "ACT"
    assert col(spark, dna.kmer_to_index("s"), s="ACT") == 7
    assert col(spark, dna.kmer_to_index("s"), s="ANT") is None
    assert col(spark, dna.clean("s"), s="ac-gRn") == "ACGN"


@pytest.mark.parametrize(
    "name,want",
    [("Escherichia_coli_K12.fa", "Escherichia_coli"), ("unknown", "unknown"), ("a.b.c", "a_b"), ("x.fna", "x"), ("a_b.fasta", "a_b"), (None, None), ("", "")],
)
def test_species(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(species_of("n")).first()[0] == want


def test_posteriors(spark):
    p = lambda h, n, t: col(spark, stats.match_probability(F.lit(h), F.lit(n), t))
    assert p(384, 384, 0.5) > 0.9999 and p(0, 384, 0.5) < 1e-10 and p(0, 0, 0.5) is None
    assert p(120, 200, 0.5) > p(12, 20, 0.5)
    for z in (-3.0, -0.5, 0.0, 0.7, 2.5):
        assert abs(col(spark, stats.normal_cdf(F.lit(z))) - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7
    assert abs(col(spark, stats.posterior_ani(F.lit(9), F.lit(10), 31)) - (10 / 12) ** (1 / 31)) < 1e-12
    assert col(spark, stats.ani_interval(F.lit(0), F.lit(10), 31)) is None


def test_adaptive_k(spark):
    k = lambda n: col(spark, stats.adaptive_k(F.lit(n)))
    assert k(5000) == 31 and k(500) == 31 and k(50) == 15 and 15 <= k(150) <= 30 and k(3) == 15
    assert stats.fallback_ks(31) == [31, 27, 23, 19, 15] and stats.fallback_ks(15) == [15] and stats.fallback_ks(17) == [17, 15]
    assert abs(col(spark, stats.anchor_sensitivity(F.lit(0.05), 10, 3, 1)) - 0.936) < 0.002


def test_scores(spark):
    assert col(spark, stats.bit_score(F.lit(1), F.lit(5))) == 0.0
    assert col(spark, stats.e_value(F.lit(1), F.lit(5), F.lit(10), 100.0)) == math.inf
    s = stats.sprt_steps()
    assert abs(s["low"] + 2.944) < 0.01 and abs(s["high"] - 2.944) < 0.01
    assert len(stats.load_seed_weights([1.0] * 7)) == 11 and stats.load_seed_weights([1.0]) == stats.SEED_WEIGHTS


def test_cigar(spark):
    r = col(spark, cigar.trimmed_statistics("c"), c="5D10=1X2I7=3D")
    assert (r["aln_len"], r["mismatches"], r["gap_opens"]) == (20, 1, 1)
    df = spark.createDataFrame([("",), (None,), ("4D",)], "c string")
    assert [r[0] for r in df.select(cigar.trimmed_statistics("c")).collect()] == [None] * 3
    assert cigar.encode(np.frombuffer(b"==XXI", np.uint8)) == "2=2X1I"


def cost(ops):
    text = bytes(ops).decode()
    total = 4 * text.count("X")
    prev = ""
    for c in text:
        if c in "ID":
            total += 2 + (6 if c != prev else 0)
        prev = c
    return total


def brute_affine(a, b):
    inf = 10**9
    n, m = len(a), len(b)
    M = [[inf] * (m + 1) for _ in range(n + 1)]
    I = [[inf] * (m + 1) for _ in range(n + 1)]  # noqa: E741
    D = [[inf] * (m + 1) for _ in range(n + 1)]
    M[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                M[i][j] = min(M[i - 1][j - 1], I[i - 1][j - 1], D[i - 1][j - 1]) + (0 if a[i - 1] == b[j - 1] else 4)
            if i:
                I[i][j] = min(min(M[i - 1][j], D[i - 1][j]) + 8, I[i - 1][j] + 2)
            if j:
                D[i][j] = min(min(M[i][j - 1], I[i][j - 1]) + 8, D[i][j - 1] + 2)
    return min(M[n][m], I[n][m], D[n][m])


@settings(max_examples=80, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=14), st.text("ACGT", min_size=1, max_size=14))
def test_affine_alignment_is_cheapest(a, b):
    ops = alignment.affine_global(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8))
    t = bytes(ops).decode()
    assert t.count("=") + t.count("X") + t.count("I") == len(a) and t.count("=") + t.count("X") + t.count("D") == len(b)
    assert cost(ops) == brute_affine(a, b)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=12), st.text("ACGT", min_size=1, max_size=16))
def test_banded_edit_is_fewest(a, b):
    ops = alignment.banded_edit(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8), 30)
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j - 1] + (x != y), d[j] + 1, new[-1] + 1))
        d = new
    assert sum(o != 61 for o in ops) == min(d)


def brute_chain(q, r, m, s):
    best = {}
    for i in sorted(range(len(q)), key=lambda i: (r[i], q[i])):
        best[i] = int(s[i] * 1000)
        for j in list(best):
            if j != i and q[j] + m[j] <= q[i] and r[j] + m[j] <= r[i]:
                a, b = q[i] - q[j] - m[j], r[i] - r[j] - m[j]
                best[i] = max(best[i], best[j] + int(s[i] * 1000) - int(0.01 * (a + b) + 0.5 * abs(a - b)))
    return max(best.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200), st.integers(1, 20)), min_size=1, max_size=15))
def test_chain_is_best(anchors):
    anchors = sorted(anchors, key=lambda a: (a[1], a[0]))
    q, r, m = (np.array(x, np.int64) for x in zip(*anchors))
    total, path = chaining.best_chain(q, q + m, r, r + m, m.astype(float))
    assert total == brute_chain(q.tolist(), r.tolist(), m.tolist(), m.astype(float).tolist())
    assert all(q[a] + m[a] <= q[b] and r[a] + m[a] <= r[b] for a, b in zip(path, path[1:]))


def test_frontier_chain_equals_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    q, r = rng.integers(0, 3000, 300), rng.integers(0, 3000, 300)
    o = np.lexsort([q, r])
    q, r, m = q[o], r[o], np.full(300, 10)
    monkeypatch.setattr(chaining, "PAIRWISE_LIMIT", 0)
    total, path = chaining.best_chain(q, q + m, r, r + m, m.astype(float))
    best = np.zeros(300)
    for i in range(300):
        ok = (q[:i] + 10 <= q[i]) & (r[:i] + 10 <= r[i])
        best[i] = 10_000 + (best[:i][ok].max() if ok.any() else 0)
    assert total == best.max() and len(path) * 10_000 == total


def test_pigeonhole_offsets():
    assert chaining.pigeonhole_anchors(32) == [0, 10, 20]
    assert chaining.pigeonhole_anchors(5) == []


def test_alignment_in_blocks_is_the_same():
    rng = np.random.default_rng(5)
    for n, m in [(40, 55), (30, 30), (1, 20), (25, 1), (0, 9), (9, 0), (60, 20)]:
        a, b = rng.choice(list(b"ACGT"), n).astype(np.uint8), rng.choice(list(b"ACGT"), m).astype(np.uint8)
        whole = alignment.affine_global(a, b).tolist()
        for cells in (1, 100, 7 * (m + 1)):
            assert alignment.affine_global(a, b, cells).tolist() == whole


def test_alignment_of_long_pairs():
    rng = np.random.default_rng(6)
    text = rng.choice(list(b"ACGT"), 8_100).astype(np.uint8)
    query = np.concatenate([text[20:4_000], text[4_003:8_060]])
    query[100] = ord("A") if query[100] != ord("A") else ord("C")
    ops = alignment.affine_global(query, text)  # more than MAX_CELLS cells
    assert len(query) * len(text) > alignment.MAX_CELLS
    assert ((ops != 68).sum(), (ops == 88).sum(), (ops == 68).sum(), (ops == 73).sum()) == (len(query), 1, len(text) - len(query), 0)


def test_signals():
    x = np.array([1, 2, 3, 4, 100], np.float32)
    n = signals.normalize(x)
    assert abs(n[2]) < 1e-6 and abs(n[3] - 1 / 1.4826) < 1e-5
    assert signals.normalize(np.full(5, 3.0)).tolist() == [0] * 5 and len(signals.normalize([])) == 0
    step = np.concatenate([np.full(30, 80.0), np.full(30, 110.0)]) + np.tile([0.1, -0.1], 30)
    means = signals.event_means(step)
    assert len(means) == 2 and abs(means[0] - 80) < 0.5 and abs(means[1] - 110) < 0.5
    assert signals.event_means(np.array([1.0, 3.0])).tolist() == [2.0] and signals.event_means(np.array([])).tolist() == [0.0]
    a = signals.Alphabet(levels=4, low=-2, high=2)
    assert a.symbols(np.array([-9, -2, -0.5, 0, 1.9, 2, np.nan])).tolist() == [0, 0, 1, 2, 3, 3, 0]
    b = signals.Alphabet(levels=3, boundaries=(0.0, 1.0))
    assert b.symbols(np.array([-1, 0, 0.5, 1, 2])).tolist() == [0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        signals.Alphabet(levels=3, boundaries=(1.0, 0.0))
    assert 60 < signals.default_levels().min() < signals.default_levels().max() < 135


def test_config():
    assert config.resolve("amr").min_identity == 0.9 and config.resolve("amr", min_identity=0.8).min_identity == 0.8
    assert config.resolve("amr", min_identity=0.7).min_identity == 0.9  # the default counts as not given
    assert config.estimate_batches(1000, 8) == -(-1000 // int(8 * 1024 * 0.8 / 30))
    with pytest.raises(ValueError):
        config.resolve("none")
