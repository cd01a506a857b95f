"""Each operator against brute force on small inputs, with nulls, empty tables, ties, repeats and clashing names."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import digest, distinctive, packing, set_join, shared_spans, text_quality, tokens, top_n

# ---- distinctive terms -----------------------------------------------------------

NODES = "query_name string, unitig_id int, genome_ids array<int>, score int, degree string"


def test_distinctive_terms(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(6), [rng.choice([1, 2, 3, 4, 5, None]) for _ in range(rng.randrange(6))], 1, "x") for _ in range(80)]
    rows += [("d", 7, None, 1, "x"), ("d", 8, [], 1, "x"), (None, 1, [9], 1, "x"), ("d", None, [9], 1, "x"), ("d", 9, [9, 9], 1, "x")] * 2
    record = defaultdict(lambda: defaultdict(set))
    for q, u, g, *_ in rows:
        if q is not None and u is not None:
            record[q][u] |= {x for x in g or [] if x is not None}
    want = {}
    spread = defaultdict(set)
    for q, us in record.items():
        near, ins = defaultdict(set), defaultdict(set)
        for u, gs in us.items():
            order = sorted(gs)
            for i, g in enumerate(order):
                ins[g].add(u)
                near[g] |= {("u", u)} | {("g", h) for h in order[max(0, i - 3) : i + 4] if h != g}
        for g in ins:
            want[q, g] = (len(near[g]), len(ins[g]), len(us))
            spread[g].add(q)
    got = {
        (r["query_name"], r["genome_id"]): (r["degree"], r["n_in"], r["n_unitigs"])
        for r in distinctive.distinctive_terms(spark.createDataFrame(rows, NODES)).collect()
    }
    assert got == want
    for r in distinctive.distinctive_terms(spark.createDataFrame(rows, NODES)).collect():
        assert r["n_records"] == len(spread[r["genome_id"]])
        assert r["score"] == pytest.approx(r["degree"] * np.log(4 / r["n_records"]))


def test_marking_genomes_come_by_their_score(spark):
    """Every case scores high whatever the window; the window decides which others do."""
    rng = random.Random(5)
    rows = []
    for q in range(30):
        own = [100 + q, 200 + q // 2]
        rows += [(f"q{q}", u, [g for g in own if rng.random() < 0.7] + rng.sample(range(12), rng.randrange(6)), 1, "x") for u in range(rng.randrange(2, 9))]
    df = spark.createDataFrame(rows, NODES)
    cases, high = {}, {}
    for w in (1, 2, 6):
        scored = distinctive.distinctive_terms(df, w)
        high[w] = {(r["query_name"], r["genome_id"]) for r in distinctive.high_scores(scored, 2).collect()}
        cases[w] = {(r["query_name"], r["genome_id"]) for r in distinctive.marking_genomes(df, window=w).collect()}
    record, inside = defaultdict(set), defaultdict(set)
    for q, u, gs, *_ in rows:
        record[q].add(u)
        for g in gs:
            inside[q, g].add(u)
    spread = defaultdict(set)
    for q, g in inside:
        spread[g].add(q)
    want = {(q, g) for (q, g), us in inside.items() if len(record[q]) >= 4 and 2 * len(us) >= len(record[q]) and len(spread[g]) <= 2}
    assert want and cases[1] == cases[2] == cases[6] == want
    assert want <= high[1] <= high[2] <= high[6] and len(high[1]) < len(high[6]) < len(inside)


def test_distinctive_empty(spark):
    empty = spark.createDataFrame([], NODES)
    assert distinctive.distinctive_terms(empty).count() == 0 == distinctive.marking_genomes(empty).count()
    assert distinctive.unitig_information(empty).count() == 0


# ---- similar sets ------------------------------------------------------------------


def jaccard_pairs(sets, t, least):
    ids = sorted(i for i in sets if len(sets[i]) >= least)
    return {(a, b) for a, b in itertools.combinations(ids, 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("hot,t,block", [(0, 0.6, 3), (2, 0.8, 2000), (200, 0.8, 2000), (1, 0.3, 5), (0, 0.05, 40)])
def test_similar_pairs(spark, monkeypatch, hot, t, block):
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(set_join.class_pairs, "__defaults__", (200, block))
    least = 3 if t > 0.3 else 1
    rng = random.Random(hot + int(10 * t))
    sets = {}
    for i in range(70):
        base = rng.choice([range(0, 8), range(4, 14), range(0, 30)])
        sets[i] = {x for x in base if rng.random() < 0.85}
    sets[90] = sets[91] = sets[92] = set(range(0, 8))
    rows = [(i, x, "c") for i, s in sets.items() for x in s] * 2 + [(None, 3, "c"), (5, None, "c"), (99, None, "c")]
    df = spark.createDataFrame(rows, "id int, token int, n string")
    got = [(r["id_a"], r["id_b"]) for r in set_join.similar_pairs(df, t, least, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(sets, t, least)


@pytest.mark.parametrize("hot,t", [(0, 0.7), (200, 0.5)])
def test_similar_pairs_of_two_tables(spark, monkeypatch, hot, t):
    monkeypatch.setattr(set_join, "BLOCK", 4)
    rng = random.Random(hot)
    make = lambda: {x for x in rng.choice([range(0, 8), range(3, 12)]) if rng.random() < 0.8}
    a, b = {i: make() for i in range(40)}, {i: make() for i in range(20, 50)}
    frame = lambda d: spark.createDataFrame([(i, str(x)) for i, s in d.items() for x in s], "id int, token string")
    got = [(r["id_left"], r["id_right"]) for r in set_join.similar_pairs_between(frame(a), frame(b), t, 1, hot).collect()]
    want = {(i, j) for i, s in a.items() for j, u in b.items() if s and u and len(s & u) / len(s | u) >= t}
    assert len(got) == len(set(got)) and set(got) == want


def test_tokens_may_hold_any_character(spark):
    rows = [(1, "a,b"), (1, "c"), (2, "a"), (2, "b,c"), (3, 'a","b'), (3, "c"), (4, "a"), (4, "b"), (4, "c"), (5, "c"), (5, "a,b")]
    df = spark.createDataFrame(rows, "id int, token string")
    assert [tuple(r) for r in set_join.similar_pairs(df, 0.8, 1).collect()] == [(1, 5)]
    assert sorted(tuple(r) for r in set_join.linked_classes(df, 0.8, 1).collect() if r["n_links"]) == [(1, 1, 1), (5, 1, 1)]


def test_similar_pairs_edges(spark):
    df = spark.createDataFrame([], "id int, token int")
    assert set_join.similar_pairs(df).count() == 0 == set_join.linked_classes(df).count()
    for wrong in (0.0, 1.1):
        with pytest.raises(ValueError):
            set_join.similar_pairs(df, wrong)
    strings = spark.createDataFrame([], "id string, token string")
    assert set_join.similar_pairs_between(strings, strings).count() == 0


# ---- digests ---------------------------------------------------------------------


def test_digest_bounds(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("big", 6000), ("small", 7), ("ties", 900), (None, 30)):
        v = rng.gamma(2.0, 10.0, n) if g != "ties" else rng.integers(0, 3, n).astype(float)
        rows += [(g, int(rng.integers(0, 5)), float(x)) for x in v]
    rows += [("small", 0, None), ("small", 0, float("nan")), ("void", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    parts = digest.digest(df, ["g"], ["day"], "v")
    merged = digest.merge(parts, ["g"])
    assert merged.where("g = 'big'").count() <= 205 and merged.where("g = 'void'").count() == 0
    est = digest.estimate(merged, ["g"], [0.0, 0.1, 0.5, 0.99, 1.0])
    values = defaultdict(list)
    for g, _, v in rows:
        if v is not None and v == v:
            values[g].append(v)
    for r in digest.certify(df, ["g"], "v", est).collect():
        v = np.array(values[r["g"]])
        assert r["n"] == len(v)
        assert (r["n_below"], r["n_up_to"]) == ((v < r["estimate"]).sum(), (v <= r["estimate"]).sum())
        assert r["rank_error"] < 0.02 or len(v) < 100
    b = digest.brackets(parts, ["g"], F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    med = {r["g"]: r["median"] for r in digest.exact_medians(df.where("v = v").join(b, "g"), ["g"], "v").collect()}
    for g, m in med.items():
        assert m == pytest.approx(np.median(values[g]))
    assert set(med) == {"big", "small", "ties"}


def test_medians_are_settled_by_merged_digests(spark, monkeypatch):
    from seqloom.llm import queries, skew

    monkeypatch.setattr(skew, "LEAST", 300)
    rng = np.random.default_rng(2)
    rows = [(i, "q", "s", int(d), float(x)) for i, (d, x) in enumerate(zip(rng.integers(0, 9, 6000), rng.normal(size=6000).round(3)))]
    recs = spark.createDataFrame(rows, "rec_id long, query_name string, species string, run_day int, identity double")
    spread, pairs = skew.Spread.measure(recs, ["query_name", "species", "run_day"]), skew.Spread.measure(recs, ["query_name", "species"])
    assert spread.hot.count() == 9 and pairs.hot.first()["_salts"] == 20
    parts = queries._day_digests(recs, spread, "identity")
    periods = spark.createDataFrame([("q", "s", 2, 7)], "query_name string, species string, day_from int, day_to int")
    inside = queries._in_period(parts, periods, pairs)
    true = float(np.median([r[4] for r in rows if 2 <= r[3] <= 7]))
    assert digest.merge(inside, queries.PERIOD).count() <= digest.DELTA < inside.count() < 4000
    b = queries._bounds(inside).first()
    assert b["lo"] <= true <= b["hi"] < b["lo"] + 0.1 and b["n"] == sum(2 <= r[3] <= 7 for r in rows)
    # far off, close by, and too near the limit to tell
    stated = spark.createDataFrame([(1, true + 0.5), (2, true), (3, true + 0.2), (4, b["hi"] - 0.2)], "id int, m double")
    off = {r["id"]: r["off"] for r in digest.settle(stated.withColumn("lo", F.lit(b["lo"])).withColumn("hi", F.lit(b["hi"])), "m", 0.2).collect()}
    assert off[1] is True and off[2] is False and (off[3] is None or b["lo"] == b["hi"])


def paf_frame(spark, rows):
    """(rec_id, query_name, target_name, num_matches, alignment_len, run_day)"""
    frame = spark.createDataFrame(rows, "rec_id long, query_name string, target_name string, num_matches int, alignment_len int, run_day int")
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.col("run_day"))
    fill = {c: F.lit(1).cast(t) for c, t in (("query_len", "int"), ("query_start", "int"), ("query_end", "int"), ("target_len", "long"), ("target_start", "long"), ("target_end", "long"), ("mapq", "int"))}
    return frame.withColumn("run_day", date).withColumns(fill).withColumn("strand", F.lit("+")).withColumn("tags", F.array(F.lit("t")))


@pytest.mark.parametrize("fine,most", [(2000.0, 100_000), (8.0, 100_000), (8.0, 0)])
def test_wrong_medians_are_found(spark, monkeypatch, tmp_path, fine, most):
    """Also with digests so small that the bounds leave nearly all open, and with a hot group."""
    from seqloom.llm import queries, skew

    monkeypatch.setattr(skew, "LEAST", 100)
    monkeypatch.setattr(queries, "FINE", fine)
    monkeypatch.setattr(queries, "MOST_OPEN", most)
    rng = random.Random(7)
    rows = [(i, rng.choice(["q", "q", "q", "r", "s"]), rng.choice(["a_b_1.fa", "a_b", "c.d"]), rng.randrange(500, 1001), 1000, rng.randrange(20)) for i in range(1500)]
    rows += [(5000 + r[0], *r[1:]) for r in rows[:200]]  # sent again
    distinct = {r[1:] for r in rows}
    values = defaultdict(list)
    for q, t, m, n, d in distinct:
        values[q, "a_b" if t[0] == "a" else "c_d"].append((d, m / n))
    stated = []
    for i in range(60):
        q, s = rng.choice(sorted(values))
        lo = rng.randrange(15)
        hi = lo + rng.randrange(8)
        v = [x for d, x in values[q, s] if lo <= d <= hi]
        if v:
            stated.append((i, q, s, float(np.median(v)) + rng.choice([0, 0.002, -0.0049, 0.0051, 0.2, -0.3]), lo, hi))
    want = sorted(i for i, q, s, m, lo, hi in stated if abs(m - np.median([x for d, x in values[q, s] if lo <= d <= hi])) > 0.005)
    stated += [(100, "q", "a_b", None, 0, 9), (101, "q", "a_b", float("nan"), 0, 9), (102, "none", "a_b", 0.5, 0, 9), (103, None, "a_b", 0.5, 0, 9)]
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c))
    summary = spark.createDataFrame(stated, "summary_id long, query_name string, species string, median_identity double, a int, b int")
    summary = summary.select("summary_id", "query_name", "species", "median_identity", day("a").alias("day_from"), day("b").alias("day_to"))
    frames = {"paf_records": paf_frame(spark, rows), "species_summary": summary}
    monkeypatch.setattr(queries, "table", lambda _, __, name: frames[name])
    assert sorted(r[0] for r in queries.p4_found(spark, "").collect()) == want


def test_digest_empty(spark):
    df = spark.createDataFrame([], "g string, day int, v double")
    assert digest.estimate(digest.merge(digest.digest(df, ["g"], ["day"], "v"), ["g"]), ["g"], [0.5]).count() == 0


# ---- shared spans ------------------------------------------------------------------


def brute_spans(records, n):
    where = defaultdict(set)
    ok = {}
    for i, t in records.items():
        ok[i] = [p for p in range(len(t) - n + 1) if not set(t[p : p + n]) - set("ACGT")]
        for p in ok[i]:
            where[t[p : p + n]].add(i)
    out = set()
    for i, t in records.items():
        hit = sorted({x for p in ok[i] if len(where[t[p : p + n]]) > 1 for x in range(p, p + n)})
        for _, run in itertools.groupby(enumerate(hit), lambda x: x[1] - x[0]):
            run = [x for _, x in run]
            out.add((i, run[0], run[-1] + 1))
    return out


@pytest.mark.parametrize("n,chunk,cells", [(5, 37, 1 << 12), (40, 1 << 20, 1 << 16), (70, 300, 1 << 16)])
def test_shared_spans(spark, monkeypatch, n, chunk, cells):
    monkeypatch.setattr(shared_spans, "CHUNK_LETTERS", chunk)
    monkeypatch.setattr(shared_spans.chunk_windows, "__defaults__", (chunk,))
    monkeypatch.setattr(shared_spans, "BUCKET_WINDOWS", 50)
    rng = random.Random(n)
    word = ["".join(rng.choice("ACGT") for _ in range(n + 13)) for _ in range(3)]
    texts = {}
    for i in range(14):
        parts = [rng.choice([*word, "N", "acgn", "A" * 9, "".join(rng.choice("ACGT") for _ in range(30))]) for _ in range(5)]
        texts[i] = "".join(parts)
    texts[20], texts[21], texts[22] = word[0] * 3, "", "A" * (n - 1)
    seqs = [(i, t, "x") for i, t in texts.items() if i % 2] + [(None, word[0], "x"), (51, None, "x")]
    units = [(i, t, 7) for i, t in texts.items() if i % 2 == 0]
    a = spark.createDataFrame(seqs * 2, "seq_id long, seq string, rec string")
    b = spark.createDataFrame(units, "unitig_id int, sequence string, text int")
    recs = shared_spans.all_records(a, b)
    got = {(r["rec_id"], r["span_start"], r["span_end"]) for r in shared_spans.named(shared_spans.shared_spans(recs, n, 2, cells)).collect()}
    assert got == brute_spans({i: t.upper() for i, t in texts.items()}, n)
    share = {r["rec"]: r for r in shared_spans.shared_share(recs, shared_spans.shared_spans(recs, n, 2, cells)).collect()}
    assert share[41]["share"] == 1.0 and share[42]["share"] == 0.0 and len(share) == len(texts) + 1


def spans_of(spark, texts, n, **more):
    """texts: {id: text} or [(id, text)]; as unitigs."""
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    a = spark.createDataFrame([], "seq_id long, seq string")
    b = spark.createDataFrame(rows, "unitig_id int, sequence string")
    found = shared_spans.shared_spans(shared_spans.all_records(a, b), n, **more)
    return sorted((r["rec_id"], r["span_start"], r["span_end"]) for r in shared_spans.named(found).collect())


def test_shared_spans_where_little_is_shared(spark, monkeypatch):
    """Chunks without a repeated window, buckets with runs alone, records that share nothing at all."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    assert spans_of(spark, {i: make(200) for i in range(6)}, 20) == []
    monkeypatch.setattr(shared_spans.chunk_windows, "__defaults__", (64,))
    same = make(30)
    texts = {i: make(200) for i in range(6)} | {7: same + make(100), 8: make(300) + same}
    assert spans_of(spark, texts, 20) == brute_spans_sorted(texts, 20)
    monkeypatch.setattr(shared_spans, "BUCKET_WINDOWS", 3)
    assert spans_of(spark, texts, 20) == brute_spans_sorted(texts, 20)
    assert spans_of(spark, {1: same, 2: same.lower()}, 30) == [(1, 0, 30), (2, 0, 30)]


def brute_spans_sorted(texts, n):
    return sorted(brute_spans(texts, n))


def test_shared_spans_of_odd_rows(spark):
    """Characters of several bytes are one position; ids with several texts keep the longest."""
    word = "ACGGTCATTAGCCGTA"
    assert spans_of(spark, {1: "é漢😀" + word + "é", 2: "N" + word}, 16) == [(1, 3, 19), (2, 1, 17)]
    assert spans_of(spark, [(1, word), (1, "T" * 40), (2, "A" + word), (3, word + "C"), (3, word + "C")], 16) == [(2, 1, 17), (3, 0, 16)]
    assert spans_of(spark, [(1, word), (1, word), (1, word.lower())], 16) == []  # copies are one record


def test_groups_of_one_hash():
    h, w, rec = np.zeros(5, np.uint64), [np.array([1, 2, 1, 2, 3])], np.array([1, 1, 2, 1, 1])
    order, first, several = shared_spans._groups(h, w, rec)
    assert [w[0][order[f]] for f in first] == [1, 2, 3] and several.tolist() == [True, False, False]
    assert all(len(x) == 0 for x in shared_spans._groups(h[:0], [w[0][:0]], rec[:0]))


def test_sketch_merges_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "MERGE_WIDTH", 2)
    monkeypatch.setattr(shared_spans, "TASK_BITS", 3)
    rng = random.Random(4)
    texts = {i: "".join(rng.choice("ACGT") for _ in range(60)) for i in range(8)} | {9: "ACGTTGCA" * 8, 11: "ACGTTGCA" * 7}
    assert spans_of(spark, texts, 24) == brute_spans_sorted(texts, 24)


def test_shared_spans_empty(spark):
    a = spark.createDataFrame([], "seq_id long, seq string")
    b = spark.createDataFrame([], "unitig_id int, sequence string")
    assert shared_spans.shared_spans(shared_spans.all_records(a, b)).count() == 0


# ---- top n -----------------------------------------------------------------------


def test_top_n(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([1, 2, 3, None]), i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s int, id int, _salt string")
    order = [F.desc_nulls_last("s"), F.asc("id")]
    got = {(r["g"], r["rank"]): r["id"] for r in top_n.top_n(df, ["g"], order, 6, rank_as="rank").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[:6]
        want |= {(g, i + 1): r[2] for i, r in enumerate(best)}
    assert got == want
    assert top_n.top_n(df, ["g"], order, 0).count() == 0 == top_n.top_n(df.limit(0), ["g"], order, 3).count()


def test_best_records_and_hits_edges(spark):
    paf = spark.createDataFrame(
        [],
        "rec_id long, query_name string, query_len int, query_start int, query_end int, strand string, target_name string, target_len long, "
        "target_start long, target_end long, num_matches int, alignment_len int, mapq int, tags array<string>, run_day date",
    )
    assert top_n.best_records(paf).count() == 0
    one = (1, "q", 9, None, 0, "+", "t", 9, 0, 9, 5, 9, None, ["a", None], None)
    shifted = (2, "q", 9, 0, None, "+", "t", 9, 0, 9, 5, 9, None, ["a", None], None)  # differs by which column is null
    again = (0, *one[1:])
    got = top_n.best_records(spark.createDataFrame([one, shifted, again, (3, None, *one[2:]), (4, "q", *one[2:11], 0, *one[12:])], paf.schema)).collect()
    assert sorted(r["rec_id"] for r in got) == [0, 2]
    hits = [("q", 1, 0.5, 10), ("q", 1, 0.5, 9), ("q", 1, 0.4, 1), ("q", 2, float("nan"), 2), ("q", 3, 1.5, 3), ("q", 4, None, 4), (None, 5, 0.9, 5), ("q", 6, -0.0, 6)]
    df = spark.createDataFrame(hits, "query_name string, genome_id int, containment double, hit_id long")
    assert [(r["genome_id"], r["hit_id"]) for r in top_n.best_hits(df).orderBy("genome_id").collect()] == [(1, 9), (6, 6)]


# ---- tokens ----------------------------------------------------------------------

TEXTS = [
    None, "", " ", "Hello world", "a  b   c \n\n d\t\te ", "it's they'll WE'RE x's", "naïve café — ß Ünicode nbsp ​ zwsp", "日本語のテキスト  混ぜ text", "<|endoftext|> special",
    "1234 5.6,7", "😀 emoji 😀😀", "tabs\t\tand\r\nCRLF\f\v", "x" * 3000, "word " * 5000, "é " * 400 + "  ", "\x1c\x85 odd   spaces",
]


def expected_ids():
    import tiktoken

    enc = tokens.FragmentEncoder.of(tokens.vocabulary_path()).encoding
    assert isinstance(enc, tiktoken.Encoding)
    return [enc.encode_ordinary(t or "") for t in TEXTS]


@pytest.mark.parametrize("slice_bytes", [10, 1 << 20])
def test_encoding_equals_whole_texts(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(tokens.text_slices, "__defaults__", (slice_bytes,))
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _id int")
    want = expected_ids()
    got = tokens.encode_corpus(df).collect()
    assert len(got) == len(rows) and all(r["ids"] == want[r["doc_id"]] for r in got)
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {i: len(w) for i, w in enumerate(want)}


def test_encoding_round_trip_and_library(spark, data):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    enc = tokens.FragmentEncoder.of(tokens.vocabulary_path()).encoding
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()}
    for r in docs.collect():
        assert enc.decode(ids[r["doc_id"]]) == (r["text"] or "")
        assert ids[r["doc_id"]] == lib.encode(r["text"] or "", add_special_tokens=False).ids


def test_encoding_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- packing -----------------------------------------------------------------------


def best_packing(sizes, cap):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, cap - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def undominated(sizes, room):
    """All feasible subsets of a multiset that no exchange betters, by trying all."""
    out = set()
    for k in range(len(sizes) + 1):
        for pick in itertools.combinations(range(len(sizes)), k):
            a = [sizes[i] for i in pick]
            rest = room - sum(a)
            if rest < 0:
                continue
            left = [sizes[i] for i in range(len(sizes)) if i not in pick]
            subsets = [c for m in range(len(a) + 1) for c in itertools.combinations(a, m)]
            if not any(sum(c) <= x <= sum(c) + rest and not (len(c) == 1 and c[0] == x) for x in left for c in subsets):
                out.add(tuple(sorted(a, reverse=True)))
    return out


def test_fillings_are_the_undominated_ones():
    assert (5, 3, 2) in undominated([6, 5, 4, 3, 2], 10) and (6, 4) in undominated([6, 5, 4, 3, 2], 10)
    rng = random.Random(3)
    for _ in range(150):
        sizes = [rng.randrange(1, 25) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 50)
        got = [f for f in packing.fillings(packing._Stock(sizes), room, room) if f]
        assert len(got) == len(set(got)) and {s for _, s in got} == undominated(sizes, room)
        assert all(w == room - sum(s) for w, s in got)


def check_bins(sizes, cap, **more):
    bins = packing.bin_completion(sizes, cap, **more)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= cap for b in bins)
    return len(bins)


def test_bin_completion_is_optimal_on_small_instances():
    assert check_bins([6, 6, 2, 7, 12, 4, 6, 11, 8, 6, 5, 6], 20) == 4
    assert check_bins([14, 29, 16, 26, 18, 30, 23, 16, 52, 14, 45, 15], 100) == 3
    rng = random.Random(6)
    for i in range(1000):
        low, high = [(1, 70), (15, 50), (20, 45), (1, 100)][i % 4]
        sizes = [rng.randrange(low, high + 1) for _ in range(rng.randrange(1, 14))]
        n = best_packing(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= n == check_bins(sizes, 100)


def test_bin_completion_beats_best_fit():
    hard = [51, 27, 23] * 20 + [49, 25, 26] * 20  # best fit alone leaves room here
    assert check_bins(hard, 101) < len(packing.best_fit_decreasing(hard, 101))
    fewer = 0
    for seed in range(40):
        rng = random.Random(seed)
        sizes = [rng.randrange(15, 45) for _ in range(60)]
        n, fit = check_bins(sizes, 100), len(packing.best_fit_decreasing(sizes, 100))
        assert n <= fit
        fewer += n < fit
    assert fewer >= 10
    assert check_bins(sizes, 100, nodes=0, least_nodes=0) == fit  # no search: the first incumbent
    assert check_bins([1] * 5000 + [2048, 2047], 2048) == 5


def test_thin_containers_are_packed_again():
    names = ["_id", "piece", "first_token", "n_tokens", "bin_id", "_home"]
    rows = [(1, 0, 0, 600, 7, -1), (2, 0, 0, 600, 8, -1), (3, 0, 0, 600, 9, -1), (4, 0, 0, 2000, 1, 0), (5, 0, 0, 900, 3, -2), (6, 0, 0, 0, None, 0)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    got = {r["_id"]: r["bin_id"] for b in packing.repack([batch, batch.slice(0, 0)], 2048, 8) for r in b.to_pylist()}
    assert got[1] == got[2] == got[3] > 1 << 60 and (got[4], got[5], got[6]) == (1, 3, None)


def test_assign_keeps_capacity():
    rng = np.random.default_rng(3)
    s = np.concatenate([rng.integers(0, 2049, 3000), np.full(50, 2048), np.zeros(9, int)])
    b = packing.assign(s)
    assert (b[s == 0] == -1).all() and (b[s > 0] >= 0).all()
    use = np.bincount(b[b >= 0], weights=s[b >= 0])
    assert use.max() <= 2048 and len(use) <= -(-s.sum() // 2048) * 1.01 + 1


def test_pack_corpus(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "Hello world"), (100, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack_corpus(df, 2048).collect()
    whole = defaultdict(int)
    for r in pieces:
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0) and r["n_tokens"] <= 2048 and r["first_token"] == r["piece"] * 2048
        whole[r["doc_id"]] += r["n_tokens"]
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len(tokens.FragmentEncoder.of(tokens.vocabulary_path()).encoding.encode_ordinary(t or ""))
    assert whole == want
    use = defaultdict(int)
    for r in pieces:
        if r["bin_id"] is not None:
            use[r["bin_id"]] += r["n_tokens"]
    assert max(use.values()) <= 2048
    cut = {r["doc_id"] for r in pieces if r["piece"] > 0}
    assert cut == {i for i in want if i is not None and want[i] > 2048 and i != 3}
    assert packing.pack_corpus(df.limit(0)).count() == 0
    u = packing.container_use(packing.pack_corpus(df)).first()
    assert u["tokens"] == sum(want.values()) and u["fullest"] <= 2048


# ---- text quality ------------------------------------------------------------------

PROSE = (
    "HIGH COURT OF ELSEWHERE\n4 U 12/09\nbetween\nA. B.\nv.\nX.\n1. The claimant was bound to consider the terms of the lease, and the respondent did not dispute it. "
    "It follows that the appeal is dismissed (C-1/02; § 5 (2) LA).\n2. The witness saw the buyer leave the harbour at 5:51. On this the court relied without reservation."
)
JUNK = {
    "table": "\n".join(f"Receipt\t{i}\t{i * 7}.50\t01.02.20{i:02d}" for i in range(10, 40)),
    "pipes": "\n".join(f"| Plan of the orchard | {i} | {i}.20 | 01.01.2001 |" for i in range(20)),
    "toc": "\n".join(f"X.{i} The boundary drawn in the older survey ............ {i}" for i in range(20)),
    "bullets": "\n".join(f"• Mill of the harbour {i}" for i in range(20)),
    "salad": "tolzan delbra kesilm " * 60,
    "hex": "\n".join(f"{i:08x}  af ae 93 10 39 47 ea e2 d7 d5 0f 0d b9 2b c4 04" for i in range(20)),
    "symbols": "{;^_!l}\\|~ ;^a*{ }~!:^ " * 40,
    "glued": "Thlwrcrtsttnsmdtlthgrmntnstrgfsfthrlrprmss" * 5,
    "loop": "had been known since th " * 40,
    "list": "\n".join(f"the holder of the permit – the terms of the lease, the burden of proof {'x' * (i % 3)}" for i in range(12)),
}


def quality(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, is_junk string, n_words int")
    words = spark.createDataFrame([(w,) for w in "the of and to in was is it that not did on had been at a".split()] + [(None,)], "word string")
    return {r["doc_id"]: r for r in text_quality.text_statistics(df, words).collect()}


def test_prose_and_junk(spark):
    wrapped = PROSE.replace(", and", ",\nand").replace("the ", "the\n", 3).replace("\n", "\r\n")
    texts = [PROSE, PROSE.upper(), wrapped, PROSE.replace(" ", " "), PROSE.replace("ti", "ti\xad​"), PROSE.replace("\n", "  ")]
    rows = quality(spark, [*texts, *JUNK.values()])
    assert [rows[i]["is_junk"] for i in range(len(texts))] == [False] * len(texts)
    for i, name in enumerate(JUNK, len(texts)):
        assert rows[i]["is_junk"] and "junk_share" in rows[i]["reasons"] and rows[i]["main_reason"], name
    mixed = quality(spark, [PROSE + "\n" + JUNK["pipes"][:200], PROSE[:150] + "\n" + JUNK["pipes"]])
    assert not mixed[0]["is_junk"] and mixed[1]["is_junk"]


def test_counts(spark):
    rows = quality(spark, ["one two. \n three#\n\n", None, "", " \n\t ", "x" * 200_000, "The cat.\n" * 30_000])
    assert (rows[0]["n_words"], rows[0]["n_lines"], rows[0]["n_chars"]) == (3, 2, 13) and rows[0]["punct_line_share"] == 0.5
    for i in (1, 2, 3):
        assert rows[i]["reasons"] == ["blank"] and not rows[i]["is_junk"] and rows[i]["n_words"] == 0 and rows[i]["main_reason"] is None
    assert rows[4]["is_junk"] and rows[5]["n_words"] == 60_000


def test_batches_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    words = spark.read.parquet(f"{data}/common_words.parquet")
    one = text_quality.text_statistics(docs, words).drop("reasons")
    many = text_quality.text_statistics(docs.repartition(7), words).drop("reasons")
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()


def test_quality_empty(spark):
    words = spark.createDataFrame([], "word string")
    assert text_quality.text_statistics(spark.createDataFrame([], "doc_id long, text string"), words).count() == 0
