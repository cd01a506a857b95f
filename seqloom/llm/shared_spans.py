"""Long exact spans shared between records.

A position is shared if it lies in ``length`` or more letters A, C, G, T that stand
verbatim in another record.  All windows of ``length`` letters are looked at:

1. prefilter: every task counts the windows of its texts in a count-min sketch (two
   hash rows of counters that stop at two); the sketches are merged block by block,
   in a tree, into one bit a cell, set where the merged count is two or more.  Counts
   are never underestimated, so no repeated window is lost.
2. exact pass: windows whose cells are all set are grouped by their exact letters
   (packed words; a hash orders them, equal hashes are compared letter by letter).  A
   chunk decides on its own what it sees in two records; it sends one entry for such
   a group, once a task, and the undecided windows of the rest, so a window that a
   third of all records share reaches its group as about one entry a task.
3. decided windows are united to runs per record.

Texts are never shuffled: exact copies of a row give the same runs, so only ids that
come with different texts are settled beforehand.  Arrays are packed (one row a chunk
and bucket), so Spark moves few rows; a bucket is a range of the hash and holds about
``BUCKET_WINDOWS`` windows however large the input is.  The merged sketch is
broadcast: at most ``depth * max_cells / 8`` bytes (64 MB) by its parameters; beyond
that it passes more windows on, never fewer.

Defined results of edge cases
* null or empty text, text shorter than ``length``: no span
* letters other than A, C, G, T (either case): no window goes across; any other
  character is one position
* rows repeated under an id are one record (the longest text, then the greatest);
  null ids are no records
* repeats inside one record alone are not shared
* no repeated window, no window, no row at all: no span
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
DEPTH = 2
MAX_CELLS = 1 << 28
BLOCK_BITS = 18
CHUNK_LETTERS = 1 << 20
BUCKET_WINDOWS = 1 << 20
MERGE_WIDTH = 64  # sketches that one merge takes at a time
TASK_BITS = 22  # a task reads about 2^22 letters or more: decides how deep the tree of merges is
SENT_KEYS = 1 << 20  # decided keys that a task remembers to have sent
MOST_BROADCAST = 100_000  # ids with several texts that may be broadcast (800 kB)
KINDS = ("sequence", "unitig")

CODES = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i


def all_records(sequences: DataFrame, unitigs: DataFrame) -> DataFrame:
    """(rec BIGINT, text) of both kinds, rec = 2 * id + kind; rows of one rec have one text.

    Ids and checksums alone are shuffled.  Ids with different texts are settled by a shuffle of
    their rows; all other rows stay where they are, copies included."""

    def one(df, id_col, text_col, kind):
        return df.where(F.col(id_col).isNotNull()).select(
            (F.col(id_col).cast("long") * 2 + kind).alias("rec"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        )

    rows = one(sequences, "seq_id", "seq", 0).unionByName(one(unitigs, "unitig_id", "sequence", 1))
    sums = rows.select("rec", F.xxhash64(F.upper("text")).alias("_h")).groupBy("rec").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    mixed = sums.where("_a <> _b").select("rec")
    n = mixed.limit(MOST_BROADCAST + 1).count()
    if not n:
        return rows
    if n <= MOST_BROADCAST:
        mixed = F.broadcast(mixed)
    best = (
        rows.join(mixed, "rec", "left_semi").withColumn("text", F.upper("text")).groupBy("rec")
        .agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("_m")).select("rec", F.col("_m.text").alias("text"))
    )
    return rows.join(mixed, "rec", "left_anti").unionByName(best)


def _pack(codes: np.ndarray, width: int) -> np.ndarray:
    """Two bits a letter of the ``width`` letters from each position on; by doubling."""
    n = len(codes) - width + 1
    out, have = None, 0
    power, size = codes.astype(np.int64), 1
    rest = width
    while rest:
        if rest & 1:
            part = power[have : have + n]
            out = part.copy() if out is None else (out << np.int64(2 * size)) | part
            have += size
        rest >>= 1
        if rest:
            power = (power[: len(power) - size] << np.int64(2 * size)) | power[size:]
            size *= 2
    return out


def word_offsets(length: int) -> tuple[int, list[int]]:
    m = -(-length // 31)
    width = -(-length // m)
    return width, [min(i * width, length - width) for i in range(m)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunk_windows(batch: pa.RecordBatch, length: int, chunk: int = CHUNK_LETTERS):
    """(words, rec, pos, hash) of the windows of consecutive texts, about ``chunk`` letters at a
    time; longer texts go in pieces that overlap by length - 1."""
    recs = batch.column(0).to_numpy()
    texts = batch.column(1)
    size = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], size)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if len(data) and data.max() > 127:  # one position a character
        inner = (data & 0xC0) == 0x80
        gone = np.concatenate([[0], np.cumsum(inner)])
        data, offsets = data[~inner], offsets - gone[offsets]
    width, steps = word_offsets(length)
    at, end = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    while at < end:
        stop = min(end, at + chunk + length - 1)
        codes = CODES[data[at:stop]]
        n = len(codes) - length + 1
        if n > 0:
            # texts of the piece, and the windows that a text's end or another letter stands in
            lo, hi = np.searchsorted(offsets, [at, stop], "right")
            edges = offsets[lo:hi] - at
            edges = edges[edges < len(codes)]
            other = np.flatnonzero(codes == 255)
            stops = np.concatenate([np.maximum(edges - length + 1, 0), np.maximum(other - length + 1, 0)])
            goes = np.concatenate([edges, other + 1])
            turns = np.bincount(stops[stops < n], minlength=n + 1) - np.bincount(np.minimum(goes, n), minlength=n + 1)
            turns[n] = 0
            keep = np.flatnonzero(np.cumsum(turns[:n]) == 0)
            if len(keep):
                row = np.repeat(np.arange(lo - 1, lo + len(edges)), np.diff(np.concatenate([[0], edges, [len(codes)]])))[keep]
                packed = _pack(codes & 3, width)
                words = [packed[keep + s] for s in steps]
                yield words, recs[row], (keep + at - offsets[row]).astype(np.int32), hash_of(words)
        at = stop - length + 1 if stop < end else end


def hash_of(words: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15, np.uint64)
    for w in words:
        h = _mix(h ^ w.astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019)
    return _mix(h)


def cells_of(h: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    rows = [h >> np.uint64(64 - bits)]
    for r in range(1, depth):
        rows.append(_mix(h + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits))
    return rows


def sketch(records: DataFrame, length: int, bits: int, depth: int = DEPTH, tasks: int = 1) -> DataFrame:
    """Merged sketch: (row, block, cells), two bitmaps of a block on end: cells counted at all, cells
    counted twice or more."""
    block_bits = min(BLOCK_BITS, bits)
    wide = (1 << block_bits) // 8
    schema = "row int, block bigint, part bigint, cells binary"

    def count(batches):
        once = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)]
        more = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)]
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch in batches:
            for _, _, _, h in chunk_windows(batch, length):
                for r, cell in enumerate(cells_of(h, bits, depth)):
                    cell = np.sort(cell.astype(np.int64))
                    again = cell[1:] == cell[:-1]
                    _set(more[r], cell[1:][again])
                    first = cell[np.concatenate([[True], ~again])]
                    seen = (once[r][first >> 3] >> (first & 7).astype(np.uint8)) & 1 == 1
                    _set(more[r], first[seen])
                    _set(once[r], first[~seen])
        for r in range(depth):
            blocks = once[r].reshape(-1, wide)
            used = np.flatnonzero(blocks.any(1))
            for at in range(0, len(used), 256):
                some = used[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), r, np.int32)),
                        pa.array(some.astype(np.int64)),
                        pa.array(np.full(len(some), part, np.int64)),
                        pa.array([_small(blocks[b], more[r][b * wide : (b + 1) * wide]) for b in some], pa.binary()),
                    ],
                    names=["row", "block", "part", "cells"],
                )

    def merge(table: pa.Table) -> pa.Table:
        once, more = np.zeros(wide, np.uint8), np.zeros(wide, np.uint8)
        for blob in table.column("cells"):
            both = _large(blob.as_py(), 2 * wide)
            more |= both[wide:] | (once & both[:wide])
            once |= both[:wide]
        cells = _small(once, more)
        one = table.slice(0, 1)
        return pa.table({"row": one.column("row"), "block": one.column("block"), "part": one.column("part"), "cells": pa.array([cells], pa.binary())})

    parts = records.mapInArrow(count, schema)
    while tasks > MERGE_WIDTH:  # about as many as read the records
        tasks = -(-tasks // MERGE_WIDTH)
        parts = parts.withColumn("part", F.floor(F.col("part") / MERGE_WIDTH)).groupBy("row", "block", "part").applyInArrow(merge, schema)
    return parts.groupBy("row", "block").applyInArrow(merge, schema).select("row", "block", "cells")


def _small(*parts: np.ndarray) -> bytes:
    return pa.compress(b"".join(x.tobytes() for x in parts), codec="zstd", asbytes=True)


def _large(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)


def _set(bitmap: np.ndarray, cells: np.ndarray) -> None:
    """Sets bits; ``cells`` ascending, so that equal bytes stand together."""
    if len(cells):
        at = cells >> 3
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bitmap[at[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (cells & 7).astype(np.uint8), first)


def _entry_type(words: int) -> np.dtype:
    return np.dtype([*[(f"k{i}", "<i8") for i in range(words)], ("rec", "<i8"), ("pos", "<i4"), ("done", "u1")])


_SPAN = np.dtype([("rec", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _groups(h: np.ndarray, words: list[np.ndarray], rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, first of each key in it, and whether the key stands in several records."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    alike = same.copy()
    for w in words:
        alike &= w[order][1:] == w[order][:-1]
    if (same & ~alike).any():  # different letters of one hash
        order = np.lexsort([*words, h])
        alike = h[order][1:] == h[order][:-1]
        for w in words:
            alike &= w[order][1:] == w[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], ~alike]))
    r = rec[order]
    return order, first, np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)


def _packed(rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct places and the bytes of the rows at each; ``place`` ascending."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    ends = (np.append(first, len(place)) * rows.dtype.itemsize).astype(np.int32)
    return place[first], pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _home(rec: np.ndarray, n: int) -> np.ndarray:
    return (_mix(rec.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def runs(rec: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of [start, end) per record; touching ones are one run."""
    order = np.lexsort([start, rec])
    rec, start, end = rec[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(rec):
        return np.zeros(0, _SPAN)
    # a running maximum within each record: records are lifted apart
    no = np.concatenate([[0], np.cumsum(rec[1:] != rec[:-1])])
    lift = no * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(rec), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (start[1:] + lift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rec)]]) - 1
    out = np.zeros(len(first), _SPAN)
    out["rec"], out["start"], out["end"] = rec[first], start[first], (reach - lift)[last]
    return out


class _Sent:
    """Decided keys that a task has sent already, so that each leaves it about once."""

    def __init__(self, words: int):
        self.none = [np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in range(words)]]
        self.keys = self.none

    def fresh(self, mine: list[np.ndarray]) -> np.ndarray:
        """Which of these keys (hash, words; ascending by hash) were not sent before; they are then."""
        known = np.zeros(len(mine[0]), bool)
        if len(self.keys[0]):
            at = np.minimum(np.searchsorted(self.keys[0], mine[0]), len(self.keys[0]) - 1)
            known = np.logical_and.reduce([k[at] == m for k, m in zip(self.keys, mine)])
        if len(self.keys[0]) > SENT_KEYS:
            self.keys = self.none
        both = [np.concatenate([k, m[~known]]) for k, m in zip(self.keys, mine)]
        order = np.argsort(both[0], kind="stable")
        self.keys = [x[order] for x in both]
        return ~known


def shared_spans(records: DataFrame, length: int = LENGTH, depth: int = DEPTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """(rec, span_start, span_end) of every longest shared run.  Rows of one rec must have one text."""
    spark = records.sparkSession
    letters = int(records.agg(F.sum(F.length("text"))).first()[0] or 0)
    bits = max(12, min(max_cells.bit_length() - 1, (2 * letters).bit_length()))
    n_buckets = max(8, -(-letters // BUCKET_WINDOWS))
    n_words = len(word_offsets(length)[1])
    entry = _entry_type(n_words)
    names = [f"k{i}" for i in range(n_words)]
    block_bits = min(BLOCK_BITS, bits)
    size = (1 << block_bits) // 8

    bitmaps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(depth)]  # the proven bound of what is broadcast
    for r in sketch(records, length, bits, depth, letters >> TASK_BITS).toLocalIterator():
        bitmaps[r["row"]][r["block"] * size : (r["block"] + 1) * size] = _large(bytes(r["cells"]), 2 * size)[size:]
    shared = spark.sparkContext.broadcast(bitmaps)

    def send(batches):
        maps, sent = shared.value, _Sent(n_words)
        for batch in batches:
            for words, rec, pos, h in chunk_windows(batch, length):
                seen = np.ones(len(h), bool)
                for r, cell in enumerate(cells_of(h, bits, depth)):
                    seen &= (maps[r][(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                words, rec, pos, h = [w[seen] for w in words], rec[seen], pos[seen], h[seen]
                order, first, several = _groups(h, words, rec)
                known = np.repeat(several, np.diff(np.append(first, len(order))))
                mine = order[known]
                local = runs(rec[mine], pos[mine], pos[mine].astype(np.int64) + length)
                ship = ~known
                ship[first] = True  # one entry of a decided key tells the other chunks
                at, done = order[ship], known[ship]
                out = np.zeros(len(at), entry)
                for name, col in zip([*names, "rec", "pos"], [*words, rec, pos]):
                    out[name] = col[at]
                out["done"] = done
                keep = ~done
                keep[done] = sent.fresh([x[at[done]] for x in (h, *words)])
                out, place = out[keep], _bucket(h[at[keep]], n_buckets)
                home = _home(local["rec"], n_buckets)
                lb = np.argsort(home, kind="stable")
                places, entries = _packed(out, place)
                homes, spans = _packed(local[lb], home[lb])
                none = pa.array([b""], pa.binary())
                for ids, data, kind in ((places, entries, 0), (homes, spans, 1)):
                    if len(ids):
                        empty = none.take(pa.array(np.zeros(len(ids), np.int32)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids.astype(np.int32)), *([data, empty] if kind == 0 else [empty, data])], names=["bucket", "entries", "spans"]
                        )

    def decide(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, entry) for x in table.column("entries").to_pylist()])
        found = [np.frombuffer(x, _SPAN) for x in table.column("spans").to_pylist()]
        words = [e[n] for n in names]
        order, first, several = _groups(hash_of(words), words, e["rec"])
        if len(first):
            s = e[order]
            known = several | np.logical_or.reduceat(s["done"].astype(bool), first)
            # what its own chunk has decided stands in its spans already, but its entry may be the
            # only window of another chunk's record group
            take = np.repeat(known, np.diff(np.append(first, len(s)))) & (s["done"] == 0)
            found.append(runs(s["rec"][take], s["pos"][take], s["pos"][take].astype(np.int64) + length))
        spans = np.concatenate(found)
        home = _home(spans["rec"], n_buckets)
        order = np.argsort(home, kind="stable")
        homes, data = _packed(spans[order], home[order])
        return pa.table({"home": pa.array(homes.astype(np.int32)), "spans": data})

    def unite(table: pa.Table) -> pa.Table:
        s = np.concatenate([np.frombuffer(x, _SPAN) for x in table.column("spans").to_pylist()])
        r = runs(s["rec"], s["start"], s["end"])
        return pa.table({"rec": r["rec"].copy(), "span_start": r["start"].copy(), "span_end": r["end"].copy()})

    return (
        records.mapInArrow(send, "bucket int, entries binary, spans binary")
        .groupBy("bucket")
        .applyInArrow(decide, "home int, spans binary")
        .groupBy("home")
        .applyInArrow(unite, "rec bigint, span_start int, span_end int")
    )


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash, so that what is ordered by it is ordered by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def named(spans: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return spans.withColumn("rec_kind", F.element_at(kinds, F.pmod("rec", F.lit(2)).cast("int") + 1)).withColumn(
        "rec_id", F.floor(F.col("rec") / 2).cast("long")
    )


def shared_share(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(rec, n_letters, n_spans, n_shared, share) of every record."""
    per = spans.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared")
    )
    n = F.col("_n")
    sizes = records.groupBy("rec").agg(F.max(F.length("text")).cast("long").alias("_n"))  # copies are one record
    return sizes.join(per, "rec", "left").select(
        "rec",
        n.alias("n_letters"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.when(n > 0, F.coalesce("n_shared", F.lit(0)) / n).otherwise(F.lit(0.0)).alias("share"),
    )
