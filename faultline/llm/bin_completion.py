"""Packing documents into as few windows as possible: bin completion by branch and bound."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, stored
from .packing import best_fit_decreasing, encoder

#: Pieces that one group holds on average.
GROUP_PIECES = 4096
#: Groups that one partition holds on average, where there are more than partitions of a shuffle.
PARTITION_GROUPS = 64
#: Of a group's pieces, one in so many is packed again with those of other groups.
OPEN_SHARE = 8
#: Steps that the search takes for one filling, and for one group for each of its pieces. The incumbent stands where they end.
FILL_STEPS, STEPS_PER_PIECE = 100, 40
#: Full windows that are searched together with the emptiest ones, and such searches in a row that may fail.
NEIGHBOURS, TRIES = 12, 24
#: Lengths that the search puts beside the largest one; fillings with more are made of largest fits.
FILL_ITEMS = 8
END_ID = 2
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def least_windows(lengths: np.ndarray, window: int) -> int:
    """A lower bound of the windows that ``lengths`` need: by their sum, and with large ones that share with no other.

    For every k up to half a window: lengths above window - k are alone, those
    above half a window have one each, and what is left of the latter holds
    what it can of the lengths from k on.
    """
    if not len(lengths):
        return 0
    at = np.bincount(lengths, minlength=window + 1).astype(np.int64)
    many, total = np.cumsum(at[::-1])[::-1], np.cumsum((at * np.arange(window + 1))[::-1])[::-1]
    many, total = np.append(many, 0), np.append(total, 0)
    half = window // 2 + 1
    k = np.arange(0, half)
    alone = many[window - k + 1]
    large, large_sum = many[half] - alone, total[half] - total[window - k + 1]
    rest = total[k] - total[half] - (large * window - large_sum)
    return int((alone + large + np.maximum(0, -(-rest // window))).max())


class Fillings:
    """Lengths that are still to be packed, and the undominated ways to fill a window with them."""

    def __init__(self, lengths: list[int], window: int) -> None:
        self.window, self.count, self.present, self.steps = window, [0] * (window + 1), 0, 0
        for x in lengths:
            self.count[x] += 1
            self.present |= 1 << x

    def take(self, items: tuple[int, ...]) -> None:
        for x in items:
            self.count[x] -= 1
            if not self.count[x]:
                self.present ^= 1 << x

    def give(self, items: tuple[int, ...]) -> None:
        for x in items:
            if not self.count[x]:
                self.present ^= 1 << x
            self.count[x] += 1

    def any_in(self, low: int, high: int) -> bool:
        return high >= low and bool(self.present >> low & (1 << (high - low + 1)) - 1)

    def sums(self, target: int, most: int, items: int, until: int) -> Iterator[tuple[int, ...]]:
        """Sets of at most ``items`` lengths up to ``most`` that add up to ``target``, large lengths first."""
        if target <= most and self.count[target]:
            yield (target,)
        least = (self.present & -self.present).bit_length() - 1
        x = min(most, target - least) if items > 1 else 0
        while self.steps < until and x > 0:
            x = (self.present & (2 << x) - 1).bit_length() - 1
            if x <= 0 or x * items < target:
                return
            self.steps += 1
            self.take((x,))
            for rest in self.sums(target - x, x, items - 1, until):
                self.give((x,))
                yield (x, *rest)
                self.take((x,))
            self.give((x,))
            x -= 1

    def dominated(self, items: tuple[int, ...], waste: int) -> bool:
        """Whether one length that is left over, in place of some of ``items`` (or none of them), would fill the window at least as well."""
        self.take(items)
        self.steps += 1
        try:
            if self.any_in(1, waste):
                return True
            for size in range(1, min(len(items), 4) + 1):
                for part in set(combinations(items, size)):
                    s = sum(part)
                    if self.any_in(s + (size == 1), s + waste):
                        return True
            return False
        finally:
            self.give(items)

    def greedy(self, room: int) -> tuple[int, ...]:
        """Lengths that fit into ``room``, always the largest that does."""
        items: list[int] = []
        while room > 0 and (x := (self.present & (2 << room) - 1).bit_length() - 1) > 0:
            items.append(x)
            self.take((x,))
            room -= x
        self.give(tuple(items))
        return tuple(items)

    def around(self, largest: int, waste_left: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Undominated fillings of a window that holds ``largest``, with their waste, least waste first.

        Once its steps are used up, the filling by largest fits is the last one;
        it is the first one where it is full with more than ``FILL_ITEMS``.
        """
        room = self.window - largest
        until = self.steps + FILL_STEPS
        many = self.greedy(room)
        if len(many) > FILL_ITEMS and sum(many) == room:
            yield many, 0
        for waste in range(min(room, waste_left) + 1):
            if waste == room:
                if not many:
                    yield (), room
                break
            for items in self.sums(room - waste, room - waste, FILL_ITEMS, until):
                if not self.dominated(items, waste):
                    yield items, waste
            if self.steps >= until:
                break
        if room - sum(many) <= waste_left and (self.steps >= until or len(many) > FILL_ITEMS):
            yield many, room - sum(many)


def search(lengths: list[int], window: int, best: int, least: int, limit: int) -> list[tuple[int, ...]] | None:
    """Windows that hold all ``lengths``, fewer than ``best`` of them; None where none are found in ``limit`` steps.

    Windows are filled one by one around the largest length left, with
    undominated fillings in order of waste; a branch ends when its waste
    leaves no room for a better packing. The search ends at ``least`` windows.
    """
    total, left = sum(lengths), Fillings(lengths, window)
    path: list[tuple[int, ...]] = []
    wastes, solution = [0], None

    def branch() -> Iterator[bool]:
        largest = left.present.bit_length() - 1
        left.take((largest,))
        for items, waste in left.around(largest, (best - 1) * window - total - wastes[-1]):
            left.take(items)
            path.append((largest, *items))
            wastes.append(wastes[-1] + waste)
            yield True
            wastes.pop()
            path.pop()
            left.give(items)
        left.give((largest,))

    stack = [branch()] if lengths else []
    while stack and left.steps < limit:
        left.steps += 1
        if next(stack[-1], None) is None:
            stack.pop()
        elif wastes[-1] <= (best - 1) * window - total and len(path) < best:
            if left.present:
                stack.append(branch())
            else:
                best, solution = len(path), list(path)
                if best <= least:
                    break
    return solution


def place(lengths: np.ndarray, solution: list[tuple[int, ...]]) -> np.ndarray:
    """Window of each of ``lengths`` in a solution."""
    where: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        where.setdefault(int(lengths[i]), []).append(i)
    seq = np.empty(len(lengths), np.int64)
    for at, items in enumerate(solution):
        for x in items:
            seq[where[x].pop()] = at
    return seq


def offsets(lengths: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Place of each length in its window, in the order in which they stand."""
    out, order = np.zeros(len(seq), np.int64), np.argsort(seq, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    at = seq[order]
    first = np.searchsorted(at, at)
    out[order] = before - before[first]
    return out


def improved(lengths: np.ndarray, seq: np.ndarray, window: int, least: int) -> np.ndarray:
    """``seq`` with fewer windows, where some of them can be packed into one less.

    The emptiest windows, together a window empty, and some of those with the
    most pieces, which leave most ways to fill, are searched as a set of their
    own; ``TRIES`` sets in a row without success end it. The choice is drawn
    from a fixed seed, so a task that runs again finds the same.
    """
    draw, tries = np.random.default_rng(len(lengths)), 0
    while tries < TRIES and len(lengths):
        n = int(seq.max()) + 1
        waste = window - np.bincount(seq, lengths, n).astype(np.int64)
        if n <= least or waste.sum() < window:
            break
        held = np.bincount(seq, minlength=n)
        order = np.argsort(-waste, kind="stable")
        few = int(np.searchsorted(np.cumsum(waste[order]), window)) + 1
        rest = order[few:]
        rest = rest[np.argsort(-(held[rest] * draw.uniform(0.3, 1, len(rest))), kind="stable")]
        chosen = np.zeros(n, bool)
        chosen[order[:few]] = chosen[rest[: NEIGHBOURS * (1 + tries % 4)]] = True
        own = np.flatnonzero(chosen[seq])
        k = int(chosen.sum())
        found = search(lengths[own].tolist(), window, k, k - 1, STEPS_PER_PIECE * len(own))
        tries += 1
        if found is not None:
            names = np.flatnonzero(chosen)
            seq = seq.copy()
            seq[own] = names[place(lengths[own], found)]
            seq, tries = np.unique(seq, return_inverse=True)[1], 0
    return seq


def bin_completion(lengths: np.ndarray, window: int, given: np.ndarray | None = None, sets: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each of ``lengths``, which are in descending order and at most ``window``.

    The incumbent is the better of best-fit decreasing and ``given``, a
    packing that is known already. The search (:func:`search`) takes all
    lengths first, then, with ``sets``, sets of windows (:func:`improved`); it
    ends when the lower bound is met or its steps are used up.
    """
    seq, offset = best_fit_decreasing(lengths, window)
    best = int(seq.max()) + 1 if len(seq) else 0
    if given is not None and len(np.unique(given)) <= best:
        seq = np.unique(given, return_inverse=True)[1]
        best, offset = int(seq.max()) + 1, offsets(lengths, seq)
    # Full windows stand; the others are searched.
    full = int(np.searchsorted(-lengths, -window, side="right"))
    rest = lengths[full:].tolist()
    least = least_windows(lengths[full:], window)
    best -= full
    if best <= least:
        return seq, offset
    solution = search(rest, window, best, least, STEPS_PER_PIECE * len(rest))
    if solution is not None:
        seq[full:], best = place(lengths[full:], solution), len(solution)
        seq[full:] += full
    seq[full:] = np.unique(seq[full:], return_inverse=True)[1] + full
    if sets:
        seq[full:] = improved(lengths[full:], seq[full:] - full, window, least) + full
    seq[:full] = np.arange(full)
    return seq, offsets(lengths, seq)


def pieces(docs: DataFrame, ranks_path: str, window: int = 1024) -> DataFrame:
    """The ids of every document, ended by id 2, whole or cut from the end into full windows: COLUMNS."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_to_numpy
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or "", allowed_special="all"), np.uint32(END_ID)).astype("<u4")
                data, n = memoryview(ids.tobytes()), len(ids)
                cuts = [0, *range((n - 1) % window + 1, n + 1, window)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    number.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(number, pa.int32()), *longs], names=COLUMNS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def still_open(lengths: np.ndarray, seq: np.ndarray, window: int, share: int) -> np.ndarray:
    """Which pieces are in the emptiest windows, as many of these as hold one of ``share`` pieces."""
    n = int(seq.max()) + 1
    waste = window - np.bincount(seq, lengths, n)
    order = np.argsort(-waste, kind="stable")
    held = np.cumsum(np.bincount(seq, minlength=n)[order])
    chosen = np.zeros(n, bool)
    chosen[order[(held <= max(len(seq) // share, 1)) & (waste[order] > 0)]] = True
    return chosen[seq]


def pack_completely(docs: DataFrame, ranks_path: str, window: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into as few sequences of at most ``window`` tokens as can be found; a row for each piece.

    A document is one piece; a longer one is cut into full windows, the first
    piece holding what is left over. Pieces, a few numbers each, are dealt
    evenly to groups of about ``group_pieces``, whatever document or source
    they come from, and each group is packed by :func:`bin_completion`. The
    emptiest windows of all groups, one of ``OPEN_SHARE`` pieces, are then
    packed again in groups of whole windows, level by level, until one group
    is left; each level is an eighth of the one before, and none gets worse.
    A null or empty text is the closing id alone. Repeated rows and rows
    without a doc_id are packed as they come; ties are ordered by document,
    start and checksum; other columns are ignored; an empty table gives no
    rows. Sequence ids hold level and group, so they are unique and the same
    after a task is run again.
    """
    cut = stored(pieces(docs, ranks_path, window))
    kind = cut.schema["doc_id"].dataType.simpleString()
    order = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "ids_crc32", "sequence_id"))]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"

    def packer(level: int, last: bool):
        def one(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(order)
            lengths = rows["length"].to_numpy()
            given = rows["sequence_id"].to_numpy() if level else None
            # The emptiest windows of all but the last level are packed again anyway.
            seq, offset = bin_completion(lengths, window, given, sets=last)
            again = np.zeros(len(seq), bool) if last else still_open(lengths, seq, window, OPEN_SHARE)
            base = ((level << 32) + rows["packing_group"][0].as_py()) << 24
            out = rows.select(COLUMNS).append_column("sequence_id", pa.array(base + seq, pa.int64()))
            return out.append_column("offset", pa.array(offset, pa.int64())).append_column("open", pa.array(again))

        return one

    count, level, done = cut.count(), 0, []
    # Row numbers of a written table: they don't change when a task is run again, and no value of a row can make a group large.
    dealt = cut.withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("deal", F.monotonically_increasing_id())
    while True:
        groups = max(1, -(-count // group_pieces))
        rows = dealt.select(*COLUMNS, "sequence_id", F.pmod(F.xxhash64("deal"), F.lit(groups)).alias("packing_group"))
        # Few bytes but much search: as many partitions as there is work for, which small sizes must not merge.
        parts = min(groups, max(spread(docs.sparkSession), groups // PARTITION_GROUPS))
        packed = stored(rows.repartition(parts, "packing_group").groupBy("packing_group").applyInArrow(packer(level, groups == 1), schema))
        done.append(packed.filter("NOT open").select(*COLUMNS, "sequence_id", "offset"))
        if groups == 1:
            break
        left = packed.filter("open")
        count, level = left.count(), level + 1
        dealt = left.select(*COLUMNS, "sequence_id", F.col("sequence_id").alias("deal"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
