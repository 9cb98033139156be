"""Aligning the tokens of two tokenizers: a map of identical tokens first, a shuffle of pairs for the rest."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, small_batches, stored

#: Pairs that are at least one in so many of all (document, pair) rows are sent to every task; there are no more of them than this.
HOT_PAIRS = 65_536
#: Links of one group that are listed one by one; in larger groups equal tokens are counted first.
LISTED_LINKS = 1 << 20
ALIGNED = (
    "groups string, n_a long, n_b long, n_groups long, n_links long, "
    "same array<int>, same_links array<long>, pairs array<long>, pair_links array<long>"
)


class TwoTokenizers:
    """A byte-level BPE (A, a rank file) and a sentencepiece model with byte fallback (B), and the bytes of their tokens.

    ``same[a]`` is the B id whose bytes are those of A id ``a``, or -1; where
    a piece and a byte token have the same bytes, it is the piece.
    """

    def __init__(self, ranks_path: str, model_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = b.get_piece_size()
        self.b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)
        ]
        self.a_size = max(ranks.values()) + 1
        self.a_length, self.b_length = np.zeros(self.a_size, np.int64), np.array([len(x) for x in self.b_bytes])
        ids = {self.b_bytes[i]: i for i in sorted(range(n), key=lambda i: not b.is_byte(i)) if not b.is_control(i) and not b.is_unknown(i)}
        self.same = np.full(self.a_size, -1, np.int64)
        for token, i in ranks.items():
            self.a_length[i], self.same[i] = len(token), ids.get(token, -1)
        # Ids as they stand in the text of the groups, by what follows them.
        self.texts = [f"{i}{end}" for size, ends in ((self.a_size, ",|"), (n, ",;")) for end in ends for i in range(size)]

    def ids(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of every text by both tokenizers; none where the bytes of the tokens are not those of the text."""
        none = np.zeros(0, np.int64)
        for text, found in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            marked = f" {text or ''}"
            # A's tokens are consecutive bytes of the text they encode; B may have normalised it.
            if not text or b"".join(map(self.b_bytes.__getitem__, found)) != marked.encode():
                yield none, none
            else:
                yield self.a.encode_to_numpy(marked, disallowed_special=()).astype(np.int64), np.array(found, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B in each of the smallest groups that begin and end together."""
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        upto = lambda x: np.diff(np.searchsorted(x, ends, "right"), prepend=0)
        return upto(ends_a), upto(ends_b)

    def group_text(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[upto_a - 1] = 1
        end_b[upto_b - 1] = 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(upto_b - in_b, in_a)] = a + self.a_size * end_a
        out[np.arange(len(b)) + np.repeat(upto_a, in_b)] = 2 * self.a_size + b + len(self.b_bytes) * end_b
        return "".join(map(self.texts.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=4)
def two_tokenizers(ranks_path: str, model_path: str) -> TwoTokenizers:
    return TwoTokenizers(ranks_path, model_path)


def links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs (A id in the upper 32 bits) and the number of their links."""
    from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    listed = in_a * in_b <= LISTED_LINKS
    each = np.repeat(np.where(listed, in_b, 0), in_a)  # links of every token of A
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    pairs = (np.repeat(a, each) << 32) + b[np.repeat(np.repeat(from_b, in_a), each) + nth]
    found, count = np.unique(pairs, return_counts=True)
    for g in np.flatnonzero(~listed).tolist():
        xs, nx = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
        ys, ny = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
        more = np.append(found, ((xs << 32)[:, None] + ys).ravel())
        found, place = np.unique(more, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, place, np.append(count, (nx[:, None] * ny).ravel()))
        count = total
    return found, count


def align(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Groups of tokens and links of every whole text of ``docs`` (doc_id, text), a narrow pass: doc_id and ALIGNED.

    ``same`` and ``same_links`` hold A ids that are linked with the B id of
    the same bytes, and how often; ``pairs`` (A id in the upper 32 bits) and
    ``pair_links`` all other links. A text that is null or empty, or that B
    normalises, has no tokens. Repeated rows and null doc_ids give a row each;
    other columns are ignored; an empty table gives no rows.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        two = two_tokenizers(ranks_path, model_path)
        texts, counts, arrays = [], [], [[], [], [], []]
        for a, b in two.ids(rows.column("text").to_pylist()):
            in_a, in_b = two.groups(a, b)
            texts.append(two.group_text(a, b, in_a, in_b))
            counts.append((len(a), len(b), len(in_a), int((in_a * in_b).sum())))
            found, count = links(a, b, in_a, in_b)
            left = found >> 32
            same = two.same[left] == found & 0xFFFFFFFF
            for column, value in zip(arrays, (left[same].astype(np.int32), count[same], found[~same], count[~same])):
                column.append(value)
        lists = [pa.array(x, pa.list_(t)) for x, t in zip(arrays, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        longs = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        names = ["doc_id", *(c.split()[0] for c in ALIGNED.split(", "))]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string()), *longs, *lists], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_batch(docs.select("doc_id", "text"), batch, f"doc_id {kind}, {ALIGNED}")


def same_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that link each A id with its equal, from one vector of vocabulary length for each task."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(batch.column("same").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(count[held], pa.int64())], names=["a", "n"])

    total = np.zeros(size, np.int64)
    for a, n in rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        total[a] = n
    return total


def score_links(aligned: DataFrame, vocabulary: int) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of its lists of links.

    The count of a pair of ids is the number of rows that hold it linked;
    ``count_sum`` adds the counts of all links of a row, ``n_best`` is the
    number of links whose count is the highest of their A id (ties included).
    Links between equal tokens are counted in vectors of ``vocabulary``
    length. Only other pairs are exploded and grouped, with a partial count
    before the shuffle. Back at the rows, counts of equal tokens and of the at
    most ``HOT_PAIRS`` most frequent pairs are looked up in place; the rest is
    joined, and no pair left can hold more than one in ``HOT_PAIRS`` of the
    joined rows. Only values bounded by a vocabulary or ``HOT_PAIRS`` reach
    the driver.
    """
    spark = aligned.sparkSession
    rows = stored(aligned.withColumn("row", F.monotonically_increasing_id()))
    same = same_counts(rows, vocabulary)
    pairs = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    best = same.copy()
    for a, n in pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n")).collect():
        best[a] = max(best[a], n)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_PAIRS >= total
    hot = sorted(map(tuple, pairs.filter(is_hot).collect()))
    known = spark.sparkContext.broadcast(
        (same, best, np.array([p for p, _ in hot], np.int64), np.array([n for _, n in hot], np.int64))
    )
    keep = [c for c in rows.columns if c not in ("same", "same_links", "pairs", "pair_links")]
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, best, hot_pairs, hot_n = known.value
        for batch in batches:
            lists = {c: batch.column(c) for c in ("same", "same_links", "pairs", "pair_links")}
            flat = {c: x.flatten().to_numpy() for c, x in lists.items()}

            def by_row(values: np.ndarray, c: str) -> np.ndarray:
                upto = np.append(0, np.cumsum(lists[c].value_lengths().to_numpy()))
                sums = np.append(0, np.cumsum(values))
                return sums[upto[1:]] - sums[upto[:-1]]

            n = same[flat["same"]]
            weight = flat["same_links"]
            sums, bests = by_row(n * weight, "same"), by_row(weight * (n == best[flat["same"]]), "same")
            at = np.minimum(np.searchsorted(hot_pairs, flat["pairs"]), max(len(hot_pairs) - 1, 0))
            hit = hot_pairs[at] == flat["pairs"] if len(hot_pairs) else np.zeros(len(at), bool)
            n = np.where(hit, hot_n[at], 0) if len(hot_pairs) else np.zeros(len(at), np.int64)
            weight = flat["pair_links"] * hit
            sums += by_row(n * weight, "pairs")
            bests += by_row(weight * (n == best[flat["pairs"] >> 32]), "pairs")
            offsets = pa.array(np.append(0, np.cumsum(by_row((~hit).astype(np.int64), "pairs"))), pa.int32())
            cold = [pa.ListArray.from_arrays(offsets, pa.array(flat[c][~hit], pa.int64())) for c in ("pairs", "pair_links")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), *cold],
                names=[*keep, "n_best", "count_sum", "pairs", "pair_links"],
            )

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_best long, count_sum long, pairs array<long>, pair_links array<long>"
    scored = stored(rows.mapInArrow(run, schema))
    cold = scored.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select("row", "x.pairs", "x.pair_links")
    top = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, best long")
    rare = pairs.filter(~is_hot).withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(top), "a")
    more = (
        cold.join(rare, F.col("pairs") == F.col("pair"))
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") == F.col("best"), F.col("pair_links")).otherwise(0)).alias("more_best"),
            F.sum(F.col("n") * F.col("pair_links")).alias("more_sum"),
        )
    )
    both = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return (
        scored.drop("pairs", "pair_links")
        .join(more, "row", "left")
        .select(*(c for c in keep if c != "row"), both("n_best", "more_best"), both("count_sum", "more_sum"))
    )


def token_links(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Counts, digest of the groups and scores of the links of every row of ``docs``; see :func:`align` and :func:`score_links`."""
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    rows = align(docs, ranks_path, model_path).withColumn("groups_sha256", digest).drop("groups")
    return score_links(rows, two_tokenizers(ranks_path, model_path).a_size)
