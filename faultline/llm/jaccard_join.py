"""N-gram Jaccard self-join with count-vector R-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, per_batch, small_batches, spread, stored

#: Token groups of a count vector.
DIMS = 64
BOX_DIMS = 32
#: Holds any count of a corner, so that the sum of minima stays an upper bound of the overlap.
CORNER = np.uint32
#: Points in a leaf, and children of a node, of an R-tree.
FANOUT = 16
#: Shingles that one join task holds of a block at most, on either side.
CHUNK_SHINGLES = 150_000
#: Shingles of small blocks that share a task on average.
UNIT_SHINGLES = 200_000
#: Differences of a pair up to which meeting is certain, and untouched groups to expect beyond.
EXACT_DIFFERENCES, MEETINGS = 48, 18.0
#: Routing keys that one partition gets on average at most.
PARTITION_KEYS = 1_500_000
#: Entries that a task gathers before it merges them.
COMBINE_BOXES = 50_000
#: Key blocks up to this size are compared pair by pair, larger ones through an R-tree.
SMALL_BLOCK = 24
#: Documents in blocks are broadcast to the texts up to this many, else joined by a shuffle.
BROADCAST_DOCS = 100_000
CACHE_WORDS = 150_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHash()


def shingle_set(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle; no words give none."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, U+0020 and U+0009-000D only
    if not words:
        return np.empty(0, U)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    width, n = min(width, len(words)), len(words)
    out = np.full(n - width + 1, width, U)
    for i in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
    return np.unique(out)


def set_digest(shingles: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None


def class_key(digest: str) -> int:
    """The first 64 bits of a digest as a signed long."""
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True)


class Spaces:
    """Key spaces in which linked pairs meet.

    Link: ``q * |A & B| >= p * |A | B|``, so sets of total size S differ in
    at most ``(q - p) * S / (p + q)`` shingles. Sizes are split into octaves;
    a pair is within one octave or on both sides of a power of two, as long as
    no set links with one of more than twice its size (``2 * p >= q``, else an
    error). Below 1 / sqrt(2) a size can be near two powers of two and has keys
    in both spaces. In each such space the shingles are dealt by hash to groups, and each non-empty
    group gives a key of its content.

    Up to ``certain`` differences (``EXACT_DIFFERENCES`` by default) there are more groups than a pair can differ
    in, so a linked pair has the same content in some group. If one of the
    two has more non-empty groups than differences, that group is not empty;
    if neither has, both also give their prefix keys (the smallest hashes,
    one more than a linked set may lack). Beyond, k groups are such that of
    them k * exp(-differences / k) >= ``MEETINGS`` stay untouched on average
    even for a pair at the threshold; that none does has a chance below
    exp(-MEETINGS).
    """

    def __init__(self, p: int, q: int, certain: int | None = None) -> None:
        if 2 * p < q:
            raise ValueError("a threshold below one half is not supported")
        self.p, self.q = p, q
        self.certain = EXACT_DIFFERENCES if certain is None else certain

    def differ(self, total: np.ndarray) -> np.ndarray:
        return (self.q - self.p) * total // (self.p + self.q)

    def octave(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Space number and the most differences of each size's own octave."""
        e = np.floor(np.log2(n)).astype(np.int64)
        e += (1 << (e + 1)) <= n
        e -= (1 << e) > n
        top = (1 << (e + 1)) - 1
        return 2 * e, self.differ(2 * top)

    def borders(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for the powers of two above and below each size, and whether it may link over them."""
        e, out = self.octave(n)[0] // 2, []
        for b, near in ((e + 1, n * self.q >= self.p * (1 << (e + 1))), (e, n * self.p <= ((1 << e) - 1) * self.q)):
            edge = 1 << b
            most = (edge - 1) * self.q // self.p
            out.append((2 * b + 1, self.differ(edge - 1 + most), near))
        return out

    def groups(self, differ: np.ndarray) -> np.ndarray:
        """Groups of a space whose pairs differ in at most ``differ`` shingles."""
        out = np.where(differ == 0, 1, differ + 3 + (differ * 15) // 100)
        for d in np.unique(differ[differ > self.certain]).tolist():
            k = 32
            while k * math.exp(-d / k) < MEETINGS:
                k += max(1, k // 32)
            out[differ == d] = min(k, d + 1)
        return out

    def prefix(self, n: int) -> int:
        return n - -(-self.p * n // self.q) + 1


def routing_keys(sets: list[np.ndarray], spaces: Spaces) -> tuple[np.ndarray, np.ndarray]:
    """Keys of non-empty ``sets`` and the index of the set of each."""
    n_all = np.array([len(s) for s in sets], np.int64)
    keys, owners = [], []
    own = spaces.octave(n_all)
    for number, most, chosen in ((*own, np.ones(len(sets), bool)), *spaces.borders(n_all)):
        which = np.flatnonzero(chosen)
        if not len(which):
            continue
        n, differ, space = n_all[which], most[which], number[which].astype(U)
        groups = spaces.groups(differ)
        tokens = mix(np.concatenate([sets[i] for i in which]) ^ U(0x5851F42D4C957F2D))
        doc = np.repeat(np.arange(len(which)), n)
        at = (tokens % groups[doc].astype(U)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(groups)])
        slot = base[doc] + at
        order = np.argsort(slot, kind="stable")
        slot, content = slot[order], mix(tokens[order] + U(0x2545F4914F6CDD1D))
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        total = np.add.reduceat(content, first)
        slot = slot[first]
        doc = np.searchsorted(base, slot, side="right") - 1
        group = (slot - base[doc]).astype(U)
        keys.append(mix(total ^ mix(space[doc] * U(1 << 32) + group)))
        owners.append(which[doc])
        filled = np.bincount(doc, minlength=len(which))
        for k in np.flatnonzero((filled <= differ) & (differ <= spaces.certain)):
            few = sets[which[k]][: spaces.prefix(int(n[k]))]
            keys.append(mix(few ^ mix(np.full(1, int(space[k]) + 1_000_003, U))))
            owners.append(np.full(len(few), which[k]))
    return np.concatenate(keys), np.concatenate(owners)


def _route(docs: DataFrame, spaces: Spaces, width: int) -> DataFrame:
    """(key, id) rows of all texts; equal rows of a batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
            by_id = {class_key(set_digest(s)): s for s in sets if len(s)}
            if by_id:
                keys, which = routing_keys(list(by_id.values()), spaces)
                ids = np.fromiter(by_id, np.int64, len(by_id))[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64)), pa.array(ids)], names=["key", "id"]
                )

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "key long, id long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (key, id), the distinct ones whose key has several ids; holds one batch and one row."""
    key = row = None  # the open key, and its first row while no second id has come
    for batch in batches:
        k, i = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if row is not None:
            k, i = np.concatenate([[row[0]], k]), np.concatenate([[row[1]], i])
        if not len(k):
            continue
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
        k, i = k[fresh], i[fresh]
        before = np.concatenate([[row is None and k[0] == key], k[1:] == k[:-1]])
        emit = before | np.append(k[1:] == k[:-1], False)
        row = None if emit[-1] else (k[-1], i[-1])
        key = k[-1]
        if emit.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[emit]), pa.array(i[emit])], names=["key", "id"])


class CountRTree:
    """R-tree over count vectors, or over boxes of them, packed by sort-tile-recursive order.

    A node keeps its box's upper corner and its range of set sizes. The
    overlap of a query with anything below a node is at most the sum of the
    coordinate minima of the query's corner and the node's.
    """

    def __init__(self, corners: np.ndarray, least: np.ndarray, most: np.ndarray, p: int, q: int) -> None:
        self.p, self.q = p, q
        axes = [-1, *np.argsort(-corners.var(0))[:2]]
        order = self.order = self._tiles(corners, least, np.arange(len(least)), axes)
        level = (corners[order], least[order], most[order])
        self.levels = [level]
        while len(level[1]) > FANOUT:
            cut = np.arange(0, len(level[1]), FANOUT)
            level = (
                np.maximum.reduceat(level[0], cut),
                np.minimum.reduceat(level[1], cut),
                np.maximum.reduceat(level[2], cut),
            )
            self.levels.append(level)

    def _tiles(self, corners: np.ndarray, sizes: np.ndarray, rows: np.ndarray, axes: list) -> np.ndarray:
        if not axes or len(rows) <= FANOUT:
            return rows
        by = sizes[rows] if axes[0] == -1 else corners[rows, axes[0]]
        rows = rows[np.argsort(by, kind="stable")]
        leaves = -(-len(rows) // FANOUT)
        slabs = max(1, round(leaves ** (1 / len(axes))))
        width = -(-leaves // slabs) * FANOUT
        return np.concatenate(
            [self._tiles(corners, sizes, rows[i : i + width], axes[1:]) for i in range(0, len(rows), width)]
        )

    def search(self, corner: np.ndarray, least: int, most: int) -> np.ndarray:
        """Entries that may link with a query, by descending bound."""
        p, q = self.p, self.q
        nodes = np.arange(len(self.levels[-1][1]))
        bound = None
        for depth, (corners, low, high) in enumerate(reversed(self.levels)):
            bound = np.minimum(corners[nodes], corner).sum(1)
            ok = (p + q) * bound >= p * (least + low[nodes])
            ok &= (low[nodes] * p <= most * q) & (least * p <= high[nodes] * q)
            nodes, bound = nodes[ok], bound[ok]
            if depth < len(self.levels) - 1:
                below = len(self.levels[-2 - depth][1])
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < below]
        return self.order[nodes[np.argsort(-bound, kind="stable")]]


def count_vector(shingles: np.ndarray, dims: int) -> np.ndarray:
    return np.bincount((shingles >> U(40)).astype(np.int64) % dims, minlength=dims)


@dataclass
class Boxes:
    """Entries of key blocks: a key, an id, a range of set sizes and the upper corner of count vectors."""

    keys: np.ndarray
    ids: np.ndarray
    least: np.ndarray
    most: np.ndarray
    corners: np.ndarray

    NAMES = ("key", "id", "least", "most", "corner")

    def take(self, rows: np.ndarray) -> Boxes:
        return Boxes(self.keys[rows], self.ids[rows], self.least[rows], self.most[rows], self.corners[rows])

    @staticmethod
    def joined(parts: list[Boxes]) -> Boxes:
        return Boxes(*(np.concatenate([getattr(b, n) for b in parts]) for n in ("keys", "ids", "least", "most", "corners")))

    @staticmethod
    def read(batch: pa.RecordBatch) -> Boxes:
        column = batch.column("corner")  # all corners have one width, so their bytes are one array
        start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
        corners = np.frombuffer(column.buffers()[2], CORNER, len(column) * BOX_DIMS, start).reshape(-1, BOX_DIMS)
        return Boxes(*(batch.column(n).to_numpy() for n in Boxes.NAMES[:4]), corners)

    def batch(self) -> pa.RecordBatch:
        width = np.dtype(CORNER).itemsize * BOX_DIMS
        raw = np.ascontiguousarray(self.corners, CORNER).tobytes()
        corner = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
        longs = [pa.array(x.astype(np.int64)) for x in (self.keys, self.ids, self.least, self.most)]
        return pa.RecordBatch.from_arrays([*longs, corner], names=list(self.NAMES))

    def may(self, a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
        """Whether the bounds allow entries ``a`` and ``b`` to link."""
        bound = np.minimum(self.corners[a], self.corners[b]).sum(1, dtype=np.int64)
        ok = (p + q) * bound >= p * (self.least[a] + self.least[b])
        return ok & (self.least[b] * p <= self.most[a] * q) & (self.least[a] * p <= self.most[b] * q)

    def may_link(self, p: int, q: int) -> tuple[Boxes, np.ndarray]:
        """Merge entries of a key whose bounds allow a link, transitively.

        Returns one entry, boxed around its parts, for each group of a key,
        and the distinct pairs (smallest id, other id) within the groups.
        """
        self = self.take(np.lexsort((self.ids, self.keys)))
        n = len(self.keys)
        head = np.concatenate([[True], self.keys[1:] != self.keys[:-1]]) if n else np.empty(0, bool)
        first = np.flatnonzero(head)
        held = np.diff(np.append(first, n))
        group = np.arange(n)
        for m in np.unique(held[(held > 1) & (held <= SMALL_BLOCK)]).tolist():
            at = first[held == m]
            x, y = np.triu_indices(m, 1)
            step = max(1, 40_000 // len(x))
            for cut in range(0, len(at), step):
                a = (at[cut : cut + step, None] + x).ravel()
                b = (at[cut : cut + step, None] + y).ravel()
                ok = self.may(a, b, p, q)
                a, b = a[ok], b[ok]
                while True:  # smallest label over the pairs, within these blocks
                    low = np.minimum(group[a], group[b])
                    if (group[a] == low).all() and (group[b] == low).all():
                        break
                    np.minimum.at(group, a, low)
                    np.minimum.at(group, b, low)
        for at, m in zip(first[held > SMALL_BLOCK].tolist(), held[held > SMALL_BLOCK].tolist()):
            part = self.take(np.arange(at, at + m))
            tree = CountRTree(part.corners.astype(np.int64), part.least, part.most, p, q)
            label = np.full(m, -1)
            for seed in range(m):
                stack = [seed] if label[seed] < 0 else []
                label[stack] = seed
                while stack:
                    x = stack.pop()
                    near = tree.search(part.corners[x], int(part.least[x]), int(part.most[x]))
                    near = near[label[near] < 0]
                    label[near] = seed
                    stack += near.tolist()
            group[at : at + m] = at + label
        order = np.argsort(group, kind="stable")
        group = group[order]
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, int)
        merged = self.take(group[cut])
        if n:
            merged.least = np.minimum.reduceat(self.least[order], cut)
            merged.most = np.maximum.reduceat(self.most[order], cut)
            merged.corners = np.maximum.reduceat(self.corners[order], cut)
        pairs = np.stack([self.ids[group], self.ids[order]], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return merged, np.unique(pairs, axis=0)


def _box_combine(p: int, q: int):
    """Merges entries in a task before the shuffle, so that a key which very many documents hold sends a few boxes."""

    def combined(parts: list[Boxes]) -> pa.RecordBatch:
        boxes, pairs = Boxes.joined(parts).may_link(p, q)
        # Pairs found here already: a key of their own carries them, in boxes that always meet.
        n = len(pairs)
        key = mix(mix(pairs[:, 0].astype(U)) + pairs[:, 1].astype(U)).astype(np.int64)
        ones, full = np.ones(2 * n, np.int64), np.full((2 * n, BOX_DIMS), np.iinfo(CORNER).max, CORNER)
        carried = Boxes(np.concatenate([key, key]), np.concatenate([pairs[:, 0], pairs[:, 1]]), ones, ones, full)
        return Boxes.joined([boxes, carried]).batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(Boxes.read(batch))
                held += batch.num_rows
            if held >= COMBINE_BOXES:
                yield combined(parts)
                parts, held = [], 0
        if held:
            yield combined(parts)

    return run


def _box_meet(p: int, q: int):
    """Pairs that may link, of entries in order of keys; holds whole keys up to about ``COMBINE_BOXES`` entries at once."""

    def met(parts: list[Boxes]) -> pa.RecordBatch:
        pairs = Boxes.joined(parts).may_link(p, q)[1]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            boxes = Boxes.read(batch)
            if held >= COMBINE_BOXES:
                # The last key may go on in this batch: what comes before its first new key ends the parts.
                fresh = np.flatnonzero(boxes.keys != parts[-1].keys[-1])
                if len(fresh):
                    old = np.arange(fresh[0])
                    yield met([*parts, boxes.take(old)])
                    boxes, parts, held = boxes.take(np.arange(fresh[0], len(boxes.keys))), [], 0
            parts.append(boxes)
            held += len(boxes.keys)
        if held:
            yield met(parts)

    return run


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def block_groups(sets: list[np.ndarray], side: np.ndarray | None, groups: Union, p: int, q: int) -> Union:
    """Joins the groups of linked pairs of a block; with ``side`` (0 or 1), of pairs across only.

    Pairs whose groups are joined already are not verified, so a group of
    near copies takes about as many verifications as it has members.
    """
    n = np.array([len(s) for s in sets], np.int64)
    counts = np.stack([count_vector(s, DIMS) for s in sets])
    every = np.arange(len(sets))
    indexed, asked = (every, every) if side is None else (every[side == 0], every[side == 1])
    if not len(indexed) or not len(asked):
        return groups
    tree = CountRTree(counts[indexed], n[indexed], n[indexed], p, q)
    for a in asked.tolist():
        for b in indexed[tree.search(counts[a], int(n[a]), int(n[a]))].tolist():
            if (side is None and b >= a) or groups.find(a) == groups.find(b):
                continue
            x, y = (sets[a], sets[b]) if n[a] < n[b] else (sets[b], sets[a])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum())
            if q * common >= p * (int(n[a] + n[b]) - common):
                groups.join(a, b)
    return groups


def _joined(rows: DataFrame, part: list[str], p: int, q: int) -> DataFrame:
    """(a, b): a member of each group of linked classes for every other member.

    ``rows`` has unit, rep, digest, shingles and the columns ``part``, by
    which the blocks that share a unit are told apart. With ``side`` and
    ``head``, classes of one head are linked already and pairs are looked for
    across sides only.
    """

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in pdf.groupby(part, sort=False):
            names = ["rep", "digest"] + (["side"] if "side" in own else [])
            own = own.drop_duplicates(names)
            ids, groups = own["rep"].to_numpy(), Union(len(own))
            if "side" in own:
                first = {}
                for i, head in enumerate(own["head"].tolist()):
                    groups.join(first.setdefault(head, i), i)
            sides = own["side"].to_numpy() if "side" in own else None
            block_groups([np.frombuffer(x, U) for x in own["shingles"]], sides, groups, p, q)
            found += [(int(ids[i]), int(ids[r])) for i in range(len(own)) if (r := groups.find(i)) != i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("unit").applyInPandas(unit, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (rep, digest, ...) with their shingles."""
    names = members.columns

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width).tobytes() for t in rows.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "shingles"]
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return per_batch(_with_texts(docs, members, width).select(*names, "text"), batch, f"{fields}, shingles binary")


def _split_blocks(docs: DataFrame, large: DataFrame, first: DataFrame, width: int, p: int, q: int) -> DataFrame | None:
    """Links (a, b) between the chunks of large blocks, whose chunks ``first`` has joined each by itself.

    The heads of the chunks' groups are joined with each other first; that
    settles a block of near copies, of which each set moved once. Of a block
    that is still in several groups, the largest group stays in its chunks,
    and all others are strays that visit each chunk: any pair of two groups
    has a stray. Strays above ``CHUNK_SHINGLES`` are cut, too.
    """
    heads = first.select(F.col("a").alias("rep"), F.col("b").alias("head"))
    placed = stored(large.join(heads, "rep", "left").withColumn("head", F.coalesce("head", "rep")))
    own = placed.filter("rep = head")
    fits = own.groupBy("block").agg(F.sum("n").alias("weight")).filter(F.col("weight") <= CHUNK_SHINGLES).select("block")
    rows = _sets(docs, own.join(fits, "block").select("rep", "digest", "block"), width)
    second = stored(_joined(rows.withColumn("unit", F.xxhash64("block")), ["block"], p, q))
    later = second.select(F.col("a").alias("head"), F.col("b").alias("later"))
    placed = placed.join(later, "head", "left").withColumn("head", F.coalesce("later", "head")).drop("later")
    groups = placed.groupBy("block", "head").agg(F.sum("n").alias("weight"))
    blocks = groups.groupBy("block").agg(
        F.max_by("head", F.struct("weight", "head")).alias("bulk"),
        (F.sum("weight") - F.max("weight")).alias("stray"),
        F.count(F.lit(1)).alias("groups"),
    )
    cuts = F.ceil(F.col("stray") / CHUNK_SHINGLES).cast("int")
    blocks = blocks.filter("groups > 1").select("block", "bulk", cuts.alias("cuts"))
    split = stored(placed.join(blocks, "block").withColumn("cut", F.pmod(F.xxhash64("digest", F.lit(1)), "cuts").cast("int")))
    if split.isEmpty():
        return second
    cols = ["rep", "digest", "block", "head"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    still = split.select(*cols, "chunk", every("cuts").alias("cut"), F.lit(0).alias("side"))
    visit = split.filter("head <> bulk").select(*cols, every("chunks").alias("chunk"), "cut", F.lit(1).alias("side"))
    members = _sets(docs, split.select("rep", "digest").distinct(), width)
    placed_sets = still.unionByName(visit).join(members, ["rep", "digest"]).withColumn("unit", F.xxhash64("block", "chunk", "cut"))
    return second.unionByName(_joined(placed_sets, ["block", "chunk", "cut"], p, q))


def _with_texts(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (rep, digest, ...) with a text that has the digest.

    The members' count is checked: few are broadcast to the texts, more are
    joined by a shuffle. Rows that share a doc_id may differ in text; only
    the text of the class counts.
    """
    few = members.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    found = docs.join(F.broadcast(members) if few else members, F.col("doc_id") == F.col("rep")).drop("doc_id")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist())
            yield batch.filter(pa.array([set_digest(shingle_set(t, width)) == d for t, d in pairs], pa.bool_()))

    small_batches(docs.sparkSession)
    shared = docs.groupBy("doc_id").count().filter("`count` > 1")
    return found if shared.isEmpty() else found.mapInArrow(same, found.schema)


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, certain: int | None = None) -> DataFrame:
    """Class of every document under Jaccard links of word shingles: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= ``percent`` (50 or more) * union of their
    sets of distinct ``width``-word shingles; component_id is the smallest
    doc_id reachable. A text with fewer words is one shingle; a null or
    wordless text has none and links with nothing (component_id is its
    doc_id). Repeated rows give repeated results; null doc_ids
    link by equal sets only; rows that share a doc_id are one document in
    links; other columns are ignored; an empty table gives no rows.

    Steps: documents with equal sets become one class. Classes are routed by
    ``Spaces`` keys. Entries of a key are compared by the bound on their
    count vectors, through an R-tree where they are many; those that it
    allows to link are merged into boxes, in each task before the shuffle and
    after it, and connected into blocks. Each block is joined by an R-tree
    over count vectors; a survivor of the bound is verified on whole sets. A
    block with more than ``CHUNK_SHINGLES`` is cut by hash into chunks, which
    are joined each by itself, then by the heads of their groups, and then
    where groups are left (``_split_blocks``). ``certain`` is the number of
    differing shingles up to which a linked pair is sure to meet; with
    ``1 << 62`` every pair is, for more keys.
    """
    spark = docs.sparkSession
    p, q = percent, 100
    spaces = Spaces(p, q, certain)
    docs = docs.select("doc_id", "text")

    def figures(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
        digests = [set_digest(s) for s in sets]
        corners = [count_vector(s, BOX_DIMS).astype(CORNER).tobytes() for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([None if d is None else class_key(d) for d in digests], pa.int64()),
                pa.array(corners, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "digest", "node", "corner"],
        )

    sized = stored(
        per_batch(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
            figures,
            "doc_id long, n_shingles long, digest string, node long, corner binary",
        )
    )
    classes = (
        sized.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("node").alias("node"))
    )
    docs_n, total = sized.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    parts = max(spread(spark), -(-int((total or 0) * 0.4) // PARTITION_KEYS))
    ordered = _route(docs, spaces, width).repartition(parts, "key").sortWithinPartitions("key", "id")
    shared = stored(ordered.mapInArrow(_shared, "key long, id long"))
    vectors = sized.filter("node is not null").select(
        F.col("node").alias("id"), F.col("n_shingles").alias("least"), F.col("n_shingles").alias("most"), "corner"
    )
    vectors = vectors.dropDuplicates(["id"])
    entries = shared.join(F.broadcast(vectors) if docs_n <= BROADCAST_DOCS else vectors, "id").select(*Boxes.NAMES)
    schema = "key long, id long, least long, most long, corner binary"
    boxes = entries.mapInArrow(_box_combine(p, q), schema).repartition(parts, "key").sortWithinPartitions("key")
    blocks = components(boxes.mapInArrow(_box_meet(p, q), "a long, b long"))
    members = stored(classes.join(blocks, "node").select("rep", "digest", "n", F.col("root").alias("block")))
    weights = members.groupBy("block").agg(F.sum("n").alias("weight"))
    members = members.join(weights, "block").withColumn(
        "chunks", F.ceil(F.col("weight") / CHUNK_SHINGLES).cast("int")
    )
    members = members.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    held = members.agg(F.sum("n").alias("n"), F.max("chunks").alias("most")).first()
    units = max(1, -(-(held["n"] or 0) // UNIT_SHINGLES))
    # Blocks of one chunk share tasks; a chunk of a larger one has its own.
    unit = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("block"), F.lit(units))).otherwise(F.xxhash64("block", "chunk"))
    rows = _sets(docs, members.select(unit.alias("unit"), "block", "chunk", "rep", "digest"), width)
    links = stored(_joined(rows, ["block", "chunk"], p, q))
    if (held["most"] or 1) > 1:
        large = members.filter("chunks > 1").select("rep", "digest", "n", "block", "chunk", "chunks")
        links = links.unionByName(_split_blocks(docs, large, links, width, p, q))
    groups = components(links).select(F.col("node").alias("rep"), "root")
    named = classes.join(groups, "rep", "left").select(
        "digest", F.coalesce("root", "rep").alias("component")
    )
    out = sized.join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; columns stay.

    Rows that repeat one doc_id count as copies; of those, the one whose
    columns have the smallest hash stays. Rows with a null doc_id stay, and so
    do null and wordless texts. An empty table stays empty.
    """
    found = stored(jaccard_components(docs, percent, width))
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    few = gone.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("`count` > 1")
    if again.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    order = F.struct(F.sha2(F.to_json(row), 256), F.xxhash64(*docs.columns))
    known = kept.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(row, order).alias("kept_row"))
    return known.select("kept_row.*").unionByName(kept.filter(F.col("doc_id").isNull()))
