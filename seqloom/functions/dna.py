"""DNA functions: column expressions, and numpy kernels for packed k-mers.

A packed k-mer of k <= 31 letters is a non-negative BIGINT with two bits a base
(A 0, C 1, G 2, T 3), the first base in the lowest bits.  The canonical form is
the smaller of the packed word and the packed reverse complement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate("ACGT"):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- column expressions ------------------------------------------------------


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), "ACGTacgt", "TGCATGCA")


def reverse_complement(seq: Column | str, unknown_to_n: bool = False) -> Column:
    """Other letters stay, or become N."""
    rc = F.reverse(complement(seq))
    return F.regexp_replace(F.upper(rc), "[^ACGT]", "N") if unknown_to_n else rc


def is_unambiguous(seq: Column | str) -> Column:
    return ~_col(seq).rlike("[^ACGTacgt]")


def clean(seq: Column | str) -> Column:
    """Upper case, letters other than A, C, G, T, N dropped (what a sequence reader keeps)."""
    return F.regexp_replace(F.upper(_col(seq)), "[^ACGTN]", "")


def gc_content(seq: Column | str) -> Column:
    """Share of G and C; 0.5 for the empty string."""
    s = _col(seq)
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, "GCgc", ""))) / n).otherwise(F.lit(0.5))


def kmer_to_index(kmer: Column | str) -> Column:
    """Base-4 number, first base most significant; null with any other letter."""
    s = F.upper(_col(kmer))
    digits = F.translate(s, "ACGT", "0123")
    return F.when(is_unambiguous(s) & (F.length(s) > 0), F.conv(digits, 4, 10).cast("long"))


def index_to_kmer(index: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_col(index).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def subsequence(seq: Column | str, start: Column, end: Column) -> Column:
    """[start, end), 0-based; clipped to the text."""
    return F.substring(_col(seq), (F.greatest(start, F.lit(0)) + 1).cast("int"), F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)).cast("int"))


# ---- kernels -----------------------------------------------------------------


def pack_forward(codes: np.ndarray, k: int, low_first: bool = True) -> np.ndarray:
    """Packed word of k letters from every position on, in log2(k) array operations."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    block, width, out, done = codes.astype(np.int64), 1, np.zeros(n, np.int64), 0
    left = k
    while left:
        if left & 1:
            piece = block[done : done + n]
            out = out | (piece << np.int64(2 * done)) if low_first else (out << np.int64(2 * width)) | piece
            done += width
        left >>= 1
        if left:
            a, b = block[: len(block) - width], block[width:]
            block = a | (b << np.int64(2 * width)) if low_first else (a << np.int64(2 * width)) | b
            width *= 2
    return out


def canonical(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(canonical word, is reverse complement) at every position; letters must be clean."""
    fwd = pack_forward(codes, k, True)
    rev = pack_forward(np.uint8(3) - codes, k, False)
    return np.minimum(fwd, rev), rev < fwd


def kmers_of(texts: pa.Array, k: int, chunk: int = 1 << 20):
    """(row, position, word, is_rc) arrays of all clean windows of consecutive texts; about ``chunk``
    letters at a time, longer texts in overlapping pieces."""
    texts = pa.compute.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, end = (int(off[0]), int(off[-1])) if len(texts) else (0, 0)
    while at < end:
        stop = min(end, at + chunk + k - 1)
        codes = CODE[data[at:stop]]
        n = len(codes) - k + 1
        if n > 0:
            place = np.arange(at, at + n)
            row = np.searchsorted(off, place, "right") - 1
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            ok = np.flatnonzero((bad[k:] == bad[:-k]) & (place + k <= off[row + 1]))
            word, rc = canonical(codes & 3, k)
            yield row[ok], (place[ok] - off[row[ok]]), word[ok], rc[ok]
        at = stop - k + 1 if stop < end else end


def explode_kmers(df: DataFrame, key_cols: list[str], seq_col: str, k: int) -> DataFrame:
    """(keys..., pos, kmer, is_rc) of every clean window of every row; narrow, Arrow-batched."""
    if not 1 <= k <= 31:
        raise ValueError("k must be 1..31")
    src = df.select(*key_cols, F.col(seq_col).alias("_seq"))
    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in key_cols)

    def run(batches):
        for batch in batches:
            for row, pos, word, rc in kmers_of(batch.column(len(key_cols)), k):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(take) for i in range(len(key_cols))]
                    + [pa.array(pos.astype(np.int32)), pa.array(word), pa.array(rc)],
                    names=[*key_cols, "pos", "kmer", "is_rc"],
                )

    return src.mapInArrow(run, f"{fields}, pos int, kmer bigint, is_rc boolean")


def explode_kmers_of(df: DataFrame, key_cols: list[str], seq_col: str, ks: list[int]) -> DataFrame:
    """The same for several k in one pass over the texts: (keys..., k, pos, kmer, is_rc)."""
    src = df.select(*key_cols, F.col(seq_col).alias("_seq"))
    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in key_cols)

    def run(batches):
        for batch in batches:
            for k in ks:
                for row, pos, word, rc in kmers_of(batch.column(len(key_cols)), k):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(i).take(take) for i in range(len(key_cols))]
                        + [pa.array(np.full(len(row), k, np.int32)), pa.array(pos.astype(np.int32)), pa.array(word), pa.array(rc)],
                        names=[*key_cols, "k", "pos", "kmer", "is_rc"],
                    )

    return src.mapInArrow(run, f"{fields}, k int, pos int, kmer bigint, is_rc boolean")


def sampled_kmers(queries: DataFrame, key_cols: list[str], seq_col: str, k: int, target: int = 384) -> DataFrame:
    """(keys..., n_sampled, pos, kmer): windows at 0, stride, 2 stride, ... with stride = max((len - k + 1) div
    target, 1).  ``n_sampled`` counts windows with other letters too; those give no row, so keys all of whose
    windows are such (or that are too short) give one row with null pos."""
    src = queries.select(*key_cols, F.coalesce(F.col(seq_col), F.lit("")).alias("_seq"))
    total = F.length("_seq") - k + 1
    stride = F.greatest(F.floor(total / target), F.lit(1)).cast("int")
    src = src.withColumn("_stride", stride).withColumn(
        "n_sampled", F.when(total > 0, F.floor((total - 1) / stride) + 1).otherwise(0).cast("int")
    )
    words = explode_kmers(src, [*key_cols, "_stride", "n_sampled"], "_seq", k)
    return words.where(F.col("pos") % F.col("_stride") == 0).drop("_stride")
