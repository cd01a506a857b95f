"""Base-level alignment of candidates.

Where a query's k-mers lie in a contig is relational (equi-join, gaps and islands
over diagonals); the text window is one ``substr``; each distinct pair of oriented
query and window is aligned once in an Arrow kernel and joined back to all
genomes that show it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.config import SearchConfig
from seqloom.functions import cigar
from seqloom.functions.dna import explode_kmers, reverse_complement, sampled_kmers
from seqloom.operators import chaining
from seqloom.session import cut, merge_join

# Costs of mismatch, gap opening and gap extension; padding of the window.
MISMATCH, GAP_OPEN, GAP_EXTEND = 4, 6, 2
PAD = 20
MAX_CELLS = 64_000_000


def affine_global(query: np.ndarray, text: np.ndarray, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Operations (bytes of ``=XID``) of a cheapest global alignment under affine gaps; D is text the query
    lacks.  Among equal costs: diagonal, then I, then D.  One vector operation a row and state.

    The traceback holds at most about ``max_cells`` cells: of larger tables the costs at the head of each block
    of rows are kept, and the blocks are computed again from the last one on."""
    n, m = len(query), len(text)
    o, e = GAP_OPEN, GAP_EXTEND
    j = np.arange(m + 1, dtype=np.int64)
    far = np.int64(1 << 40)
    rows = max(1, min(n, max_cells // (m + 1)))

    def block(at, best, ins, keep):
        """Rows at + 1 .. at + rows from the costs of row ``at``: costs of the last row, traceback if wanted."""
        size = min(rows, n - at)
        trace = [np.zeros((size + 1, m + 1), t) for t in (np.uint8, bool, bool)] if keep else None
        for i in range(1, size + 1):
            opened = best + o + e
            ext = ins + e
            ins_open = opened <= ext
            ins = np.minimum(opened, ext)
            diag = np.full(m + 1, far)
            diag[1:] = best[:-1] + np.where(text == query[at + i - 1], 0, MISMATCH)
            base = np.minimum(diag, ins)
            # cheapest deletion that ends at each column: a running minimum of where it opens
            run = np.minimum.accumulate(base - e * j)
            dele = np.full(m + 1, far)
            dele[1:] = run[:-1] + o + e * j[1:]
            best = np.minimum(base, dele)
            if keep:
                trace[0][i] = np.where(diag <= best, 0, np.where(ins <= best, 1, 2))  # 0 diagonal, 1 insertion, 2 deletion
                trace[1][i] = ins_open
                trace[2][i, 1:] = base[:-1] + o + e <= dele[1:]
        return best, ins, trace

    heads = [(np.where(j > 0, o + e * j, 0), np.full(m + 1, far))]
    for at in range(0, n - rows, rows):
        heads.append(block(at, *heads[-1], False)[:2])
    ops, i, k, state = [], n, m, None
    for b in range(len(heads) - 1, -1, -1):
        at = b * rows
        source, ins_open, del_open = block(at, *heads[b], True)[2]
        while i > at and (i or k):
            s = source[i - at, k] if state is None else state
            if s == 0:
                ops.append(61 if query[i - 1] == text[k - 1] else 88)
                i, k = i - 1, k - 1
            elif s == 1:  # a gap may go on in the block before
                ops.append(73)
                state = None if ins_open[i - at, k] else 1
                i -= 1
            else:
                ops.append(68)
                state = None if del_open[i - at, k] or k == 1 else 2
                k -= 1
    ops += [68] * k
    return np.array(ops[::-1], np.uint8)


def banded_edit(query: np.ndarray, text: np.ndarray, most: int) -> np.ndarray | None:
    """Operations of a fewest-edits alignment that begins at the text's start and may end anywhere in it
    (least such column); None beyond ``most`` edits.  Diagonal, then I, then D."""
    n, m = len(query), len(text)
    if not n or not m:
        return None
    inf = most + 1
    table = np.full((n + 1, m + 1), inf, np.int32)
    table[0, : min(most, m) + 1] = np.arange(min(most, m) + 1)
    col = np.arange(m + 1)
    for i in range(1, n + 1):
        base = np.full(m + 1, inf, np.int64)
        base[0] = i if i <= most else inf
        lo, hi = max(1, i - most), min(i + most, m)
        if lo <= hi:
            part = np.minimum(table[i - 1, lo - 1 : hi] + (text[lo - 1 : hi] != query[i - 1]), table[i - 1, lo : hi + 1] + 1)
            base[lo : hi + 1] = part
            left = np.minimum.accumulate(base[lo - 1 : hi + 1] - col[lo - 1 : hi + 1])
            base[lo : hi + 1] = np.minimum(part, left[1:] + col[lo : hi + 1])
        table[i] = np.minimum(base, inf)
    k = int(table[n].argmin())
    if table[n, k] > most:
        return None
    ops, i = [], n
    while i or k:
        here = table[i, k]
        same = i and k and query[i - 1] == text[k - 1]
        if i and k and here == table[i - 1, k - 1] + (0 if same else 1):
            ops.append(61 if same else 88)
            i, k = i - 1, k - 1
        elif i and here == table[i - 1, k] + 1:
            ops.append(73)
            i -= 1
        else:
            ops.append(68)
            k -= 1
    return np.array(ops[::-1], np.uint8)


def align_pairs(pairs: DataFrame, method: str = "wfa") -> DataFrame:
    """(query_seq, text) distinct -> cigar, num_matches, edits, alignment_len, lead and tail (text left
    over at either end).  Null where no alignment is found; ``graph`` falls back to ``wfa``."""

    def one(q: bytes, t: bytes):
        a, b = np.frombuffer(q, np.uint8), np.frombuffer(t, np.uint8)
        ops = banded_edit(a, b, int(0.15 * len(a)) + 5) if method == "graph" else None
        tail_extra = 0
        if ops is not None:
            tail_extra = len(b) - int((ops != 73).sum())
        else:
            ops = affine_global(a, b)
        if ops is None:
            return None
        solid = np.flatnonzero((ops == 61) | (ops == 88))
        if not len(solid):
            return None
        lead = int((ops[: solid[0]] == 68).sum())
        tail = int((ops[solid[-1] + 1 :] == 68).sum()) + tail_extra
        core_edits = int((ops == 88).sum() + (ops == 73).sum() + (ops[solid[0] : solid[-1]] == 68).sum())
        return cigar.encode(ops), int((ops == 61).sum()), core_edits, len(ops), lead, tail

    fields = ["cigar", "num_matches", "edits", "alignment_len", "lead", "tail"]

    def run(batches):
        for batch in batches:
            rows = [one((q or "").encode(), (t or "").encode()) if q and t else None for q, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cols = [pa.array([r[i] if r else None for r in rows], pa.string() if i == 0 else pa.int32()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["query_seq", "text", *fields])

    # few, heavy rows: spread them evenly before the kernel
    spread = pairs.select("query_seq", "text").distinct().repartition("query_seq", "text")
    return spread.mapInArrow(run, "query_seq string, text string, cigar string, num_matches int, edits int, alignment_len int, lead int, tail int")


def placements(queries: DataFrame, contigs: DataFrame, candidates: DataFrame, k: int, target: int = 384) -> DataFrame:
    """(query_name, genome_id, contig_no, strand, window_start, window_end, n_seeds): the widest co-linear
    fragment of each query, genome and strand, projected to the whole query and padded, in contig
    coordinates."""
    sized = queries.select("query_name", "seq", F.length("seq").alias("query_len"))
    samples = sampled_kmers_with_strand(sized, k, target)
    words = explode_kmers(contigs, ["genome_id", "contig_no", "contig_len"], "seq", k)
    words = merge_join(words, samples.select("kmer").distinct(), "kmer", "left_semi")
    hits = merge_join(words.withColumnRenamed("pos", "cpos").withColumnRenamed("is_rc", "c_rc"), samples, "kmer")
    hits = merge_join(hits, candidates.select("query_name", "genome_id"), ["query_name", "genome_id"], "left_semi")
    reverse = F.col("c_rc") != F.col("is_rc")
    qpos = F.when(reverse, F.col("query_len") - F.col("pos") - k).otherwise(F.col("pos"))
    rows = hits.select(
        "query_name", "genome_id", "contig_no", "contig_len", "query_len", F.when(reverse, "-").otherwise("+").alias("strand"), qpos.alias("q"), "cpos"
    ).withColumn("diag", F.col("cpos") - F.col("q"))
    key = ["query_name", "genome_id", "strand", "contig_no"]
    w = Window.partitionBy(*key).orderBy("diag", "q")
    tol = F.greatest(F.floor(F.col("query_len") / 10), F.lit(200))
    rows = rows.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(w) > tol, 1).otherwise(0)).withColumn("_frag", F.sum("_new").over(w))
    frag = rows.groupBy(*key, "_frag", "contig_len", "query_len").agg(
        F.min("q").alias("_qlo"), (F.max("q") + k).alias("_qhi"), F.min("cpos").alias("_clo"), F.count(F.lit(1)).alias("n_seeds")
    )
    order = Window.partitionBy("query_name", "genome_id", "strand").orderBy(F.desc(F.col("_qhi") - F.col("_qlo")), "contig_no", "_frag")
    best = frag.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    start = F.greatest(F.col("_clo") - F.col("_qlo"), F.lit(0))
    return best.select(
        "query_name", "genome_id", "contig_no", "strand", "n_seeds", "query_len",
        F.greatest(start - PAD, F.lit(0)).alias("window_start"), F.least(start + F.col("query_len") + PAD, F.col("contig_len")).alias("window_end"),
    )


def anchor_placements(queries: DataFrame, contigs: DataFrame, candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """The same for candidates found by anchors alone (no whole k-mer): the fragment with most anchors, whose
    diagonals follow within the padding."""
    k_anchor, n_anchors = (7, 5) if config.cross_species else (10, 3)
    pairs = candidates.select("query_name", "genome_id")
    own = merge_join(queries, pairs.select("query_name").distinct(), "query_name", "left_semi").select("query_name", "seq", F.length("seq").alias("query_len"))
    samples = sampled_kmers(own, ["query_name"], "seq", config.kmer_size, config.sample_target).select("query_name", "pos")
    a = chaining.window_anchors(own.select("query_name", "seq"), samples, config.kmer_size, k_anchor, n_anchors).select("query_name", F.col("query_pos").alias("q"), "w").distinct()
    words = merge_join(chaining.text_words(contigs, ["genome_id", "contig_no", "contig_len"], k_anchor), a.select("w").distinct(), "w", "left_semi")
    freq = words.groupBy("w").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") <= config.max_seed_freq)
    asked = merge_join(merge_join(a, pairs, "query_name"), freq.select("w"), "w", "left_semi")
    rows = merge_join(asked, words.withColumnRenamed("pos", "cpos"), ["w", "genome_id"]).withColumn("diag", F.col("cpos") - F.col("q"))
    key = ["query_name", "genome_id", "contig_no"]
    w = Window.partitionBy(*key).orderBy("diag", "q")
    rows = rows.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(w) > PAD, 1).otherwise(0)).withColumn("_frag", F.sum("_new").over(w))
    frag = rows.groupBy(*key, "_frag", "contig_len").agg(F.min("diag").alias("_d"), F.count(F.lit(1)).alias("n_seeds"))
    order = Window.partitionBy("query_name", "genome_id").orderBy(F.desc("n_seeds"), "contig_no", "_frag")
    best = merge_join(frag.withColumn("_r", F.row_number().over(order)).where("_r = 1"), own.select("query_name", "query_len"), "query_name")
    start = F.greatest(F.col("_d"), F.lit(0))
    return best.select(
        "query_name", "genome_id", "contig_no", F.lit("+").alias("strand"), "n_seeds", "query_len",
        F.greatest(start - PAD, F.lit(0)).alias("window_start"), F.least(start + F.col("query_len") + PAD, F.col("contig_len")).alias("window_end"),
    )


def sampled_kmers_with_strand(queries: DataFrame, k: int, target: int) -> DataFrame:
    rows = sampled_kmers(queries, ["query_name", "query_len"], "seq", k, target)
    return rows.select("query_name", "query_len", "pos", "kmer", "is_rc")


def align(queries: DataFrame, contigs: DataFrame, ranked: DataFrame, config: SearchConfig = SearchConfig(), method: str = "wfa") -> DataFrame:
    """PAF-shaped records of the first ``max_target_seqs`` candidates of each query, filtered by identity,
    coverage and score ratio, best of each genome, at most ``max_target_seqs``.

    ``contigs`` (genome_id, contig_no, seq, base_offset), ``ranked`` as from ``search.containment``.
    """
    top = cut(ranked.where(F.col("rank") <= config.max_target_seqs))  # used again below, as the windows' texts are
    sized = contigs.withColumn("contig_len", F.length("seq"))
    windows = placements(queries, sized, top, config.kmer_size, config.sample_target)
    if config.pigeonhole and "solid" in ranked.columns:
        windows = windows.unionByName(anchor_placements(queries, sized, top.where("solid = 0"), config))
    texts = merge_join(windows, sized.select("genome_id", "contig_no", "seq", "base_offset"), ["genome_id", "contig_no"]).select(
        *windows.columns, "base_offset", F.substring("seq", F.col("window_start") + 1, F.col("window_end") - F.col("window_start")).alias("text")
    )
    q = queries.select("query_name", "seq")
    oriented = cut(
        merge_join(texts, q, "query_name")
        .withColumn("query_seq", F.when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq")))
        .drop("seq")
    )
    aligned = merge_join(oriented, align_pairs(oriented, method), ["query_seq", "text"]).where(F.col("cigar").isNotNull())
    lengths = contigs.groupBy("genome_id").agg(F.sum(F.length("seq")).alias("target_len"))
    start = F.col("base_offset") + F.col("window_start") + F.col("lead")
    end = F.col("base_offset") + F.col("window_end") - F.col("tail")
    rec = merge_join(merge_join(aligned, top, ["query_name", "genome_id"]), lengths, "genome_id").select(
        "query_name", "query_len", F.lit(0).alias("query_start"), F.col("query_len").alias("query_end"), "strand", "genome_id", "target_len",
        start.alias("target_start"), end.alias("target_end"), "num_matches", "alignment_len", "rank", "containment", "edits", "cigar",
        F.floor(F.col("containment") * F.col("query_len")).cast("int").alias("as_score"),
    )
    return filter_records(rec, config)


def filter_records(rec: DataFrame, config: SearchConfig) -> DataFrame:
    identity = F.col("num_matches") / F.col("query_len")
    cover = (F.col("query_end") - F.col("query_start")) / F.col("query_len")
    rec = rec.where((identity >= config.min_identity) & (cover >= config.min_query_coverage))
    order = [F.desc("as_score"), F.asc("genome_id"), F.asc("target_start"), F.asc("strand")]
    w = Window.partitionBy("query_name").orderBy(*order)
    rec = rec.withColumn("_first", F.first("as_score").over(w)).where(F.col("as_score") >= config.min_score_ratio * F.col("_first"))
    one = Window.partitionBy("query_name", "genome_id").orderBy(F.desc("as_score"), F.desc("num_matches"), "target_start", "strand")
    rec = rec.withColumn("_g", F.row_number().over(one)).where("_g = 1").withColumn("out_rank", F.row_number().over(w))
    if config.max_target_seqs:
        rec = rec.where(F.col("out_rank") <= config.max_target_seqs)
    return rec.drop("_first", "_g").withColumn("identity", identity)
