"""Filling fixed-capacity containers: bin completion branch-and-bound.

Sizes are tokens of a public tokenizer.  A text of more tokens than the capacity
is cut into pieces of exactly the capacity and a rest; no other text is cut.

Each task packs the items of its partition by themselves (a block): sizes are counted
and packed within the task that counts them, so texts are never shuffled, work grows in
proportion to the data, and a lost task is packed again alike.  The thin containers that
blocks end with are then packed again, those of ``JOINED_BLOCKS`` blocks together; for
that the pieces' ids and sizes are shuffled.

Within a block, bins are filled around the largest item left.  Of the fillings only
undominated ones are tried: a filling is dominated if some of its items (or none) may be
exchanged for one larger item that is left over, without going beyond the room.  A branch
ends when its waste makes the incumbent unbeatable, and the search when a lower bound
(sum of sizes; items that can't share a bin) is met; the first incumbent is the
best-fit-decreasing solution.  Fillings are made lazily and taken up by least waste in
runs of ``RUN``, none is left out.  One parameter bounds the search: ``nodes``, the
fillings looked at per item (at least ``LEAST_NODES`` in all).  Within it the result is
optimal for the block; beyond it the best packing so far stands.  It is always whole.

Defined results of edge cases
* null, empty text: one row with piece 0, no tokens, no container
* ties and repeated rows: every row is packed by itself; null ids pass through
* one text longer than many capacities: full pieces are containers of their own
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.tokens import FragmentEncoder, text_slices, vocabulary_path

CAPACITY = 2048
NODES = 8
LEAST_NODES = 50_000
RUN = 16
BLOCK_ITEMS = 1 << 18
JOINED_BLOCKS = 256
THIN = 0.95  # containers filled less are packed again,
THIN_BINS = 64  # the thinnest of a block, so many at most


class _Stock:
    """Sizes left, with counts; ``mask`` has the bits of sizes that are left at all."""

    def __init__(self, sizes):
        values, counts = np.unique(np.asarray(sizes, np.int64), return_counts=True)
        self.count = dict(zip(values.tolist(), counts.tolist()))
        self.mask = sum(1 << s for s in self.count)
        self.total = int(sum(sizes))

    def take(self, sizes) -> None:
        for s in sizes:
            self.count[s] -= 1
            self.total -= s
            if not self.count[s]:
                self.mask ^= 1 << s

    def put(self, sizes) -> None:
        for s in sizes:
            if not self.count[s]:
                self.mask ^= 1 << s
            self.count[s] += 1
            self.total += s


def _up_to(mask: int, most: int) -> int:
    """Largest bit of at most ``most``; 0 if none."""
    return max((mask & ((2 << most) - 1)).bit_length() - 1, 0)


def _spread(mask: int, by: int) -> int:
    """Bits moved up by 0 .. by."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        mask |= mask << step
        done += step
    return mask


def _dominated(chosen: list[int], rest: int, left: int) -> bool:
    """Whether an item of ``left`` (mask of sizes) may take the place of some of ``chosen``, or of none,
    within ``rest`` more room.  A single item of the same size is no gain."""
    single = several = 0
    for s in chosen:
        several |= (single | several) << s
        single |= 1 << s
    better = _spread(1 | several, rest)
    if rest:
        better |= _spread(single << 1, rest - 1)
    return bool(better & left)


def fillings(stock: _Stock, room: int, most_waste: int) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """Undominated fillings of ``room`` as (waste, sizes), largest items first; None for each filling looked
    at in vain."""
    count, mask = stock.count, stock.mask
    chosen: list[int] = []
    used: dict[int, int] = {}
    top = room
    sums = None
    if stock.total < 64 * room:  # else smaller items fill any room
        order = sorted(s for s, n in count.items() if n)
        sums = [0]
        for s in order:
            sums.append(sums[-1] + s * count[s])
    while True:
        while s := _up_to(mask, min(room, top)):
            chosen.append(s)
            used[s] = used.get(s, 0) + 1
            if used[s] == count[s]:
                mask ^= 1 << s
            room -= s
            top = s
        if room <= most_waste and not _dominated(chosen, room, mask):
            yield room, tuple(chosen)
        else:
            yield None
        while chosen:
            s = chosen.pop()
            if used[s] == count[s]:
                mask |= 1 << s
            used[s] -= 1
            room += s
            top = s - 1
            # what follows instead of s must be more than s, or s would do better, and waste little enough
            reach = room if sums is None else min(room, sums[bisect.bisect_right(order, top)])
            if top and reach > s and room - reach <= most_waste:
                break
        else:
            return


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by items that can't share a bin with others of a size."""
    values = np.sort(np.asarray(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(values)])
    at = lambda x, side: np.searchsorted(values, x, side)
    k = np.unique(np.concatenate([[0], values[values <= capacity // 2]]))
    big, half, least = at(capacity - k, "right"), at(capacity / 2, "right"), at(k, "left")
    alone, large = len(values) - big, big - half
    room = large * capacity - (total[big] - total[half])
    more = np.maximum(0, -(-(total[half] - total[least] - room) // capacity))
    return int(max((alone + large + more).max(), -(-total[-1] // capacity)))


def best_fit_decreasing(sizes, capacity: int) -> list[tuple[int, ...]]:
    """Bins as tuples of sizes; the first incumbent."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, (s, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if room > s:
            bisect.insort(rooms, (room - s, b))
    return [tuple(b) for b in bins]


def bin_completion(sizes, capacity: int = CAPACITY, nodes: int = NODES, least_nodes: int = LEAST_NODES) -> list[tuple[int, ...]]:
    """Bins as tuples of sizes.  Sizes are 1..capacity."""
    sizes = [int(s) for s in sizes]
    if not sizes:
        return []
    incumbent = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    stock, total = _Stock(sizes), sum(sizes)
    path: list[tuple[int, ...]] = []
    frames: list[list] = []  # largest item, fillings to come, fillings at hand
    waste, steps = 0, max(nodes * len(sizes), least_nodes)

    def most_waste() -> int:
        return (len(incumbent) - 1) * capacity - total - waste

    def at_hand(frame: list) -> bool:
        """Gets the next run of fillings, least waste first."""
        nonlocal steps
        found = []
        for f in frame[1]:
            steps -= 1
            if f is not None:
                found.append(f)
                if not f[0] or len(found) == RUN:
                    break
            if steps <= 0:
                break
        frame[2] = sorted(found, key=lambda f: (-f[0], -len(f[1])))
        return bool(found)

    def opened() -> list:
        big = stock.mask.bit_length() - 1
        stock.take((big,))
        return [big, fillings(stock, capacity - big, max(most_waste(), 0)), []]

    if len(incumbent) > bound:
        frames.append(opened())
    while frames and steps > 0 and len(incumbent) > bound:
        frame = frames[-1]
        if len(path) == len(frames):  # back from below
            bin_ = path.pop()
            waste -= capacity - sum(bin_)
            stock.put(bin_[1:])
        if most_waste() < 0 or not (frame[2] or at_hand(frame)):
            stock.put((frame[0],))
            frames.pop()
            continue
        w, rest = frame[2].pop()
        if w > most_waste():
            continue
        stock.take(rest)
        path.append((frame[0], *rest))
        waste += w
        if stock.mask:
            frames.append(opened())
        elif len(path) < len(incumbent):
            incumbent = list(path)
    return incumbent


def assign(sizes: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> np.ndarray:
    """Bin number of every item of a block; -1 for size 0."""
    out = np.full(len(sizes), -1, np.int64)
    full = np.flatnonzero(sizes == capacity)
    out[full] = np.arange(len(full))
    at = len(full)
    order = np.argsort(sizes, kind="stable")
    order = order[(sizes[order] > 0) & (sizes[order] < capacity)]
    part = sizes[order]
    values, first = np.unique(part, return_index=True)
    nxt = dict(zip(values.tolist(), first.tolist()))
    for bin_ in bin_completion(part.tolist(), capacity, nodes):
        for s in bin_:
            out[order[nxt[s]]] = at
            nxt[s] += 1
        at += 1
    return out


def thin_bins(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Which items stand in a thin container."""
    use = np.bincount(bins[bins >= 0], weights=sizes[bins >= 0])
    thin = np.argsort(use, kind="stable")[:THIN_BINS]
    thin = thin[use[thin] < THIN * capacity]
    return np.isin(bins, thin)


def repack(batches, capacity: int, nodes: int):
    """Packs the rows whose ``_home`` is below 0 again, each home by itself; bin ids change only where that
    saves containers."""
    held = []
    for batch in batches:
        home = batch.column(5).to_numpy()
        firm = home >= 0
        if firm.any():
            yield batch.filter(pa.array(firm)).select(range(5))
        if not firm.all():
            held.append(batch.filter(pa.array(~firm)))
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks().sort_by([("_home", "ascending"), ("bin_id", "ascending"), ("n_tokens", "ascending")])
    homes, bins, sizes = (rows.column(c).to_numpy() for c in ("_home", "bin_id", "n_tokens"))
    bins = bins.copy()
    edges = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        again = assign(sizes[a:b], capacity, nodes)
        if again.max() + 1 < len(np.unique(bins[a:b])):
            bins[a:b] = again + ((1 << 62) + (int(-homes[a]) << 32))
    for out in rows.set_column(4, "bin_id", pa.array(bins)).select(range(5)).to_batches():
        yield out


def pack_corpus(
    docs: DataFrame,
    capacity: int = CAPACITY,
    nodes: int = NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(id, piece, first_token, n_tokens, bin_id) of every piece; bin_id is null where nothing takes
    space.  A block is a partition, or ``block_items`` consecutive pieces of a larger one (bounds
    the task's memory).  ``nodes`` bounds the search for better packings, per item."""
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = FragmentEncoder.of(path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        made = part << 40
        ids, pieces, firsts, sizes, held = [], [], [], [], 0

        def flush(made):
            size = np.concatenate(sizes)
            bins = assign(size, capacity, nodes)
            labels = pa.array(bins + made, mask=bins < 0)
            home = np.where(thin_bins(size, bins, capacity), -1 - part // JOINED_BLOCKS, part)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.array(np.concatenate(pieces).astype(np.int32)),
                    pa.array(np.concatenate(firsts)),
                    pa.array(size.astype(np.int32)),
                    labels,
                    pa.array(home.astype(np.int64)),
                ],
                names=["_id", "piece", "first_token", "n_tokens", "bin_id", "_home"],
            )
            for x in (ids, pieces, firsts, sizes):
                x.clear()
            return batch, made + int(bins.max(initial=-1)) + 1

        for batch in batches:
            for a, b, data, starts in text_slices(batch.column(1)):
                n = encoder.encode(data, starts, counts_only=True)
                k = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(b - a), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                ids.append(batch.column(0).slice(a, b - a).take(pa.array(row)))
                pieces.append(piece)
                firsts.append(piece * capacity)
                sizes.append(np.minimum(capacity, n[row] - piece * capacity))
                held += len(row)
                if held >= block_items:
                    out, made = flush(made)
                    held = 0
                    yield out
        if held:
            yield flush(made)[0]

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_id {kind}, piece int, first_token bigint, n_tokens int, bin_id bigint, _home bigint"
    )
    schema = f"_id {kind}, piece int, first_token bigint, n_tokens int, bin_id bigint"
    return out.repartition("_home").mapInArrow(lambda b: repack(b, capacity, nodes), schema).withColumnRenamed("_id", id_col)


def container_use(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_bins, n_pieces, tokens, capacity, fill): how well the containers are filled."""
    used = pieces.where(F.col("bin_id").isNotNull())
    per = used.groupBy("bin_id").agg(F.sum("n_tokens").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.sum("_n").alias("n_pieces"),
        F.sum("_t").alias("tokens"),
        F.max("_t").cast("long").alias("fullest"),
        F.lit(capacity).cast("long").alias("capacity"),
        (F.sum("_t") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"),
    )
