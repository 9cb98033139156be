"""Packing documents into fixed windows by best-fit decreasing over a segment tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Pieces that one packing group holds on average.
GROUP_PIECES = 4096
PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long"

_ENCODERS: dict[tuple[str, str, int], object] = {}


def encoder(ranks_path: str, special: str = "<|endoftext|>", special_id: int = 50256):
    """The byte-level BPE of a rank file, with its special string mapped inside texts as its library does by default."""
    import base64

    import public_tokenizers
    import tiktoken

    key = (ranks_path, special, special_id)
    if key not in _ENCODERS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id}
        )
    return _ENCODERS[key]


class OpenWindows:
    """Open windows in a segment tree indexed by remaining capacity; each leaf counts its windows."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.ids: dict[int, list[int]] = {}

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.ids.setdefault(capacity, []).append(window)
            self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest remaining capacity of ``least`` or more."""
        tree, i = self.tree, least + self.size
        if not tree[i]:
            while True:
                if i & (i + 1) == 0:  # on the right edge: nothing larger
                    return None
                if not i & 1 and tree[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.ids[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each of ``lengths``, which must be in descending order and at most ``window``."""
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_windows, n = OpenWindows(window), 0
    for k, length in enumerate(lengths.tolist()):
        found = open_windows.take(length) if length < window else None
        if found is None:
            found, n = (window, n), n + 1
        capacity, at = found
        seq[k], offset[k] = at, window - capacity
        open_windows.put(capacity - length, at)
    return seq, offset


def pieces(docs: DataFrame, ranks_path: str, window: int = 1024) -> DataFrame:
    """Full windows and the rest of every document's ids: doc_id, start, length, ids_crc32, doc_tokens.

    A document's ids end with id 0; a null text has that id only.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_to_numpy
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or "", allowed_special="all"), np.uint32(0)).astype("<u4")
                data, n = memoryview(ids.tobytes()), len(ids)
                for at in range(0, n, window):
                    row.append(k)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + window)]))
                    total.append(n)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, *longs], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, {PIECE_SCHEMA}")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def pack(docs: DataFrame, ranks_path: str, window: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``window`` tokens; one row for each piece.

    Documents longer than a window are cut into full windows and a rest first.
    Pieces, which are a few numbers each, are dealt by a hash of document and
    start to groups of about ``group_pieces``, however many come from one
    document or source; each group is packed by itself, longest piece first,
    into the tightest open window that a segment tree over remaining
    capacities finds. Sequence ids hold the group in the upper bits, so they
    are unique and the same after a task is run again. Ties are ordered by
    document, start and checksum. Repeated rows are packed as often as they
    come, and so is a row whose doc_id is null; other columns are ignored; an
    empty table gives no rows.
    """
    cut = stored(pieces(docs, ranks_path, window))
    groups = max(1, -(-cut.count() // group_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]

    def one(rows: pa.Table) -> pa.Table:  # Arrow, not pandas: a null beside it would make a long id a float
        rows = rows.sort_by(order)
        seq, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        base = rows["packing_group"][0].as_py() << 32
        return rows.select(names).append_column("sequence_id", pa.array(base + seq)).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    schema = f"doc_id {_kind(docs)}, {PIECE_SCHEMA}, sequence_id long, offset long"
    return dealt.groupBy("packing_group").applyInArrow(one, schema)
