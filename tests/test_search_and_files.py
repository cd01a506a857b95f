"""Planted truth: genomes made here, genes cut out of them."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqloom.config import SearchConfig
from seqloom.operators import alignment, graph, index_store, search, summaries
from seqloom.sinks import text
from seqloom.sources import fasta, paf, signals


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    gene, core = dna(rng, 400), dna(rng, 600)
    mutated = list(gene)
    for i in range(30, 400, 60):
        mutated[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[mutated[i]]
    genomes = [
        [dna(rng, 900), dna(rng, 300) + gene + dna(rng, 300)],
        [dna(rng, 500) + rc(gene) + dna(rng, 200) + core],
        [dna(rng, 400) + "".join(mutated) + dna(rng, 100) + core],
        [dna(rng, 300) + core + dna(rng, 800)],
    ]
    rows, plant = [], {0: ("+", 900 + 300), 1: ("-", 500), 2: ("+", 400)}
    for g, contigs in enumerate(genomes):
        at = 0
        for c, s in enumerate(contigs):
            rows.append((g, c, f"c{c}", s, at))
            at += len(s)
    c = spark.createDataFrame(rows, "genome_id int, contig_no int, contig_name string, seq string, base_offset long")
    q = spark.createDataFrame([("gene", gene), ("core", core), ("none", dna(rng, 200)), ("short", gene[:20]), ("blank", "")], "query_name string, seq string")
    return c, q, plant, gene


def test_containment_finds_the_source(world):
    c, q, _, _ = world
    rows = {(r["query_name"], r["genome_id"]): r for r in search.containment(q, c).collect()}
    assert rows["gene", 0]["containment"] == 1.0 == rows["gene", 1]["containment"] and rows["gene", 2]["containment"] < 0.7
    assert ("gene", 3) not in rows and {g for n, g in rows if n == "core"} == {1, 2, 3} and not [k for k in rows if k[0] in ("none", "short", "blank")]
    p = {r["query_name"]: r for r in search.prevalence(q, c).collect()}
    assert p["core"]["genomes_at_best"] == 3 and p["core"]["best_genome"] == 1 and p["none"]["best_genome"] is None and p["blank"]["kmers_hit"] == 0


@pytest.mark.parametrize("method", ["wfa", "graph"])
def test_alignment_finds_the_plant(world, method):
    c, q, plant, gene = world
    out = alignment.align(q, c, search.containment(q, c), SearchConfig(), method).where("query_name = 'gene'").collect()
    got = {r["genome_id"]: r for r in out}
    assert set(got) == {0, 1, 2}
    for g, (strand, start) in plant.items():
        r = got[g]
        assert (r["strand"], r["target_start"], r["target_end"]) == (strand, start, start + 400)
        assert r["num_matches"] == (400 if g < 2 else 393) and r["edits"] == (0 if g < 2 else 7)
    assert [r["out_rank"] for r in sorted(out, key=lambda r: -r["as_score"])][0] == 1


def test_pigeonhole_finds_what_has_no_whole_word(spark):
    rng = random.Random(8)
    gene, other = dna(rng, 300), dna(rng, 300)
    far = list(gene)
    for i in range(11, 290, 12):  # stretches of 11 letters, no whole word of 31
        far[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[far[i]]
    texts = {0: dna(rng, 700) + "".join(far) + dna(rng, 400), 1: dna(rng, 900), 2: dna(rng, 200) + other + dna(rng, 200)}
    c = spark.createDataFrame([(g, 0, "c", s, 0) for g, s in texts.items()], "genome_id int, contig_no int, contig_name string, seq string, base_offset long")
    q = spark.createDataFrame([("gene", gene), ("other", other)], "query_name string, seq string")
    exact = search.containment(q, c).collect()
    assert {(r["query_name"], r["genome_id"]) for r in exact} == {("other", 2)}
    config = SearchConfig(pigeonhole=True)
    ranked = search.containment(q, c, config)
    rows = {(r["query_name"], r["genome_id"]): r for r in ranked.collect()}
    credited = lambda s: sum(any(gene[p + o : p + o + 10] in s for o in (0, 10, 20)) for p in range(270))
    assert {g: rows["gene", g]["shared"] if ("gene", g) in rows else 0 for g in texts} == {g: credited(s) for g, s in texts.items()}
    assert rows["gene", 0]["rank"] == 1 and rows["gene", 0]["solid"] == 0 and credited(texts[0]) > 100
    assert [k for k in rows if k[0] == "other"] == [("other", 2)] and rows["other", 2]["solid"] == rows["other", 2]["shared"] == 270
    got = {r["query_name"]: r for r in alignment.align(q, c, ranked, config).where("genome_id != 1").collect()}
    assert (got["gene"]["target_start"], got["gene"]["target_end"], got["gene"]["edits"]) == (700, 1000, 24)


def test_adaptive_k_serves_short_queries(world):
    c, q, _, gene = world
    ks = {r["query_name"]: r["k"] for r in search.adaptive_containment(q, c).collect()}
    assert ks["gene"] == 31 and ks["short"] == 15 and "blank" not in ks


def test_mapq(world):
    c, q, _, _ = world
    r = {(x["query_name"], x["genome_id"]): x["mapq"] for x in search.mapping_quality(search.containment(q, c)).collect()}
    assert r["gene", 0] == 30 and r["core", 2] == 30


def test_index_grows(spark, world, tmp_path):
    c, q, _, _ = world
    folder = str(tmp_path / "idx")
    index_store.build(c.where("genome_id < 2"), folder)
    index_store.build(c.where("genome_id < 2"), folder)  # finished stages are not repeated
    assert index_store.add_genomes(c.where("genome_id >= 2").withColumn("genome_id", F.col("genome_id") - 2), folder) == 1
    assert index_store.needs_compaction(spark, folder)
    index_store.compact(spark, folder, str(tmp_path / "one"))
    one = {(r["query_name"], r["genome_id"]): r["shared"] for r in index_store.search_index(q, str(tmp_path / "one")).collect()}
    flat = {(r["query_name"], r["genome_id"]): r["shared"] for r in search.containment(q, c).collect()}
    grown = {(r["query_name"], r["genome_id"]): r["shared"] for r in index_store.search_index(q, folder).collect()}
    assert one == flat == grown


def test_compaction_spells_every_word_once(spark):
    # a line a-b-c-d, a branch at d, and a cycle
    rows = [(1, 10, 11, "x"), (2, 11, 12, "x"), (3, 12, 13, "x"), (4, 13, 14, "x"), (5, 14, 15, "y"), (6, 14, 16, "x"), (20, 30, 31, "x"), (21, 31, 30, "x")]
    out = graph.compact_unitigs(spark.createDataFrame(rows, "kmer long, prefix long, suffix long, color_key string")).collect()
    chains = {}
    for r in out:
        chains.setdefault(r["chain"], set()).add(r["kmer"])
    assert sorted(map(sorted, chains.values())) == [[1, 2, 3, 4], [5], [6], [20, 21]]
    assert {r["kmer"]: r["place"] for r in out if r["kmer"] < 5} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_sequence_files(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">s1 words\nACGTx\nNN\n>empty\n\n>s2\r\nac\r\n")
    with gzip.open(tmp_path / "a.fasta", "wt") as f:  # gzip by content, not by name
        f.write(">z\nTT\n")
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / "q.fna").write_text("@r1 x\nACGT\n+\n@@II\n@r2\nGG\n+\nAC\n")
    rows = sorted((r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path)).collect())
    assert rows == [("r1", "ACGT"), ("r2", "GG"), ("s1", "ACGTNN"), ("s2", "AC"), ("z", "TT")]
    g = {r["contig_name"]: (r["genome_id"], r["genome_name"], r["base_offset"]) for r in fasta.read_genomes(spark, str(tmp_path)).collect()}
    assert g["z"] == (0, "a", 0) and g["s2"] == (1, "b", 6) and g["r2"][0] == 2


def test_paf_and_blast(spark, tmp_path):
    lines = ["# c", "q\t100\t0\t100\t+\tt.fa\t900\t10\t110\t96\t100\t60\tcg:Z:3D96=4X2D\tNM:i:9", "short\t1", "q\tx\t0\t50\t-\tu\t9\t1\t2\t40\t50\t1"]
    (tmp_path / "a.paf").write_text("\n".join(lines))
    df = paf.read_paf(spark, str(tmp_path / "a.paf"))
    rows = df.orderBy("target_name").collect()
    assert len(rows) == 2 and rows[1]["query_len"] == 0 and rows[0]["tags"] == ["cg:Z:3D96=4X2D", "NM:i:9"]
    b = text.blast_lines(df, 1000).collect()[0][0].split("\t")
    assert len(b) == 12 and b[2] == "96.000" and b[3:6] == ["100", "4", "0"] and b[6] == "1" and float(b[11]) > 0
    assert sorted(r[0] for r in text.paf_lines(df).collect())[0].count("\t") >= 11


def test_summaries(spark):
    rows = [("q", 100, "Escherichia_coli_a", 90), ("q", 100, "Escherichia_coli_b", 80), ("q", 100, "Klebsiella_pneumoniae_x", 70)]
    df = spark.createDataFrame(rows, "query_name string, query_len int, target_name string, num_matches int")
    s = {r["species"]: r for r in summaries.species_summary(df, 100).collect()}
    assert s["Escherichia_coli"]["hit_count"] == 2 and s["Escherichia_coli"]["prevalence"] == 0.02 and s["Klebsiella_pneumoniae"]["stdev_identity"] == 0
    q = spark.createDataFrame([("q", 100), ("z", 5)], "query_name string, query_len int")
    per, agg = summaries.surveillance(df, q, 100)
    out = sorted(r[0] for r in text.surveillance_lines(per).collect())
    assert out[-1] == "z\t5\tNO_HITS" + "\t0" * 9 and agg.count() == 2


def test_signal_files(spark, tmp_path):
    (tmp_path / "a.slow5").write_text("#v\nread_id\tx\traw_signal\nr1\t5\t1,2,3\n")
    (tmp_path / "a.csv").write_text("# c\nr1,1.5,2\n\n")
    assert signals.read_signal(spark, str(tmp_path / "a.slow5")).first()["signal"] == [1.0, 2.0, 3.0]
    assert signals.read_signal(spark, str(tmp_path / "a.csv")).first()["signal"] == [1.5, 2.0]


def test_signal_longest_matches_equal_brute_force(spark):
    from seqloom.functions.dna import CODE
    from seqloom.operators import signals as sg

    rng = random.Random(4)
    a = sg.Alphabet(levels=8)
    seqs = {0: dna(rng, 300), 1: dna(rng, 250)}
    c = spark.createDataFrame([(g, s, 0) for g, s in seqs.items()], "genome_id int, seq string, base_offset long")
    coded = lambda s: a.symbols(sg.standardize(sg.expected_signal(CODE[[ord(x) for x in s]], sg.default_levels()))).tolist()
    texts = {(g, strand): coded(s if strand == "+" else rc(s)) for g, s in seqs.items() for strand in "+-"}
    reads = {
        "r": texts[0, "+"][50:80] + texts[1, "-"][20:27] + texts[0, "-"][100:109] + texts[1, "+"][60:85] + texts[0, "+"][200:240],
        "s": [rng.randrange(8) for _ in range(60)],
    }
    want, places = {}, set()
    for name, x in reads.items():
        i = 0
        while i + 6 <= len(x):
            at = lambda n: [(g, st, p) for (g, st), t in texts.items() for p in range(len(t) - n + 1) if t[p : p + n] == x[i : i + n]]  # noqa: B023, E731
            n = next((n for n in range(len(x) - i, 5, -1) if at(n)), 0)
            if n:
                want[name, i] = n
                places |= {(name, i, n, *h) for h in at(n)}
            i += n or 1
    assert max(want.values()) >= 30 and {n for n in want.values()} - {6, 8, 10}
    s = spark.createDataFrame(list(reads.items()), "read_id string, symbols array<int>")
    kept = sg.skip_matched(sg.longest_matches(s, c, a))
    assert {(r["read_id"], r["qpos"]): r["len"] for r in kept.collect()} == want
    got = sg.match_places(kept, s, c, a).collect()
    assert {tuple(r) for r in got} == places and len(got) == len(places)
    top = sg.longest_search(s, c, a, min_hits=2).where("read_id = 'r' and rank = 1").first()
    own = [p for p in places if p[0] == "r" and p[3] == 0]
    assert top["genome_id"] == 0 and top["n_hits"] == len(own) and top["match_len"] == sum(p[2] for p in own)


def _tables(spark, folder, unitigs, sequences):
    spark.createDataFrame(unitigs, "unitig_id long, sequence string").write.parquet(f"{folder}/unitigs.parquet")
    spark.createDataFrame(sequences, "seq_id long, genome_id int, contig_name string, seq string").write.parquet(f"{folder}/sequences.parquet")


def test_whole_contigs_are_complemented(spark, tmp_path):
    from hashlib import md5

    from seqloom.plans import searching

    _tables(spark, tmp_path, [(1, "A")], [(1, 7, "c", "ACGTACGTAC" * 20 + "RYTT")])
    r = searching.reverse_complements(spark, str(tmp_path)).first()
    tail = rc("ACGTACGTAC" * 20)
    assert (r["n"], r["rc"], r["rc_n"]) == (204, md5(f"AAYR{tail}".encode()).hexdigest(), md5(f"AANN{tail}".encode()).hexdigest())


def test_short_unitigs_are_genes(spark, tmp_path):
    from seqloom.plans import registry

    rng = random.Random(10)
    short = dna(rng, 40)
    _tables(spark, tmp_path, [(1, short), (2, "ACG")], [(1, 7, "c", dna(rng, 60) + short + dna(rng, 60))])
    rows = {r["query_name"]: (r["kmers_hit"], r["best_genome"]) for r in registry.queries()["prevalence_all"](spark, str(tmp_path)).collect()}
    assert rows == {"u1": (10, 7), "u2": (0, None)}


def test_frequent_anchors_and_all_candidates(spark, tmp_path):
    from seqloom.plans import aligning

    rng = random.Random(9)
    gene, lost = dna(rng, 120), dna(rng, 60)
    rows = [(i, i, "c", dna(rng, 50) + gene + dna(rng, 50)) for i in range(5)] + [(9, 9, "c", "".join(lost[:10] + dna(rng, 15) for _ in range(250)))]
    _tables(spark, tmp_path, [(1, gene), (2, lost)], rows)
    graph_hits = {(r["query_name"], r["genome_id"]) for r in aligning.aligned_hits_graph(spark, str(tmp_path)).collect()}
    assert graph_hits == {("u1", g) for g in range(5)}
    anchors = {(r["query_name"], r["genome_id"]): r["n_anchors"] for r in aligning.pigeonhole(spark, str(tmp_path)).collect()}
    assert anchors["u2", 9] >= 1  # the word stands in 250 places


def test_every_position_is_looked_up(spark, tmp_path):
    from seqloom.plans import seeding

    texts = {3: "ACGTA", 5: "G", 9: "CC"}  # all shorter than a stride of 97
    spark.createDataFrame(list(texts.items()), "unitig_id long, sequence string").write.parquet(str(tmp_path / "unitigs.parquet"))
    got = [tuple(r) for r in seeding.position_lookup_all(spark, str(tmp_path)).orderBy("pos").collect()]
    want = [x for u, s in texts.items() for x in [*[(u, o) for o in range(len(s))], (None, None)]]
    assert got == [(i, *x) for i, x in enumerate(want)]


def test_stream_sessions_equal_batch(spark, data, tmp_path):
    from seqloom.streaming.arrivals import sessions

    e = spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, late="1000 days").writeStream.format("memory").queryName("sess").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda df: sorted((r["user_id"], r["started"], r["n_values"]) for r in df.collect())
    assert key(spark.table("sess")) == key(sessions(e))
