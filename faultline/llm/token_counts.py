"""Token counts by heap-and-linked-list byte-pair merging, without identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch

SPACE = "▁"
#: Distinct words whose counts one Python worker remembers before it starts afresh.
CACHE_WORDS = 1_000_000


def merge_table(path: str) -> tuple[dict[str, float], frozenset[str], frozenset[str]]:
    """Merge ranks of a sentencepiece BPE model with byte fallback.

    Returns (rank of every piece of two or more characters, single characters
    that are pieces, characters inside no longer piece). Lower ranks merge
    first.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks, single, inside = {}, set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if len(piece) == 1:
            single.add(piece)
        else:
            ranks[piece] = -model.get_score(i)
            inside.update(piece)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece spans words; words can't be counted apart")
    return ranks, frozenset(single), frozenset(inside)


def count_merges(symbols: str, ranks: dict[str, float]) -> int:
    """Merges that byte-pair encoding makes in ``symbols``: the lowest-rank adjacent pair first, then the leftmost.

    Symbols form a doubly linked list over positions; the heap holds
    (rank, left position, left text, right text) and entries whose ends have
    changed since are skipped.
    """
    n = len(symbols)
    part = list(symbols)
    get = ranks.get
    heap = []
    last = part[0]
    for i in range(1, n):
        this = part[i]
        if (r := get(last + this)) is not None:
            heap.append((r, i - 1, last, this))
        last = this
    if not heap:
        return 0
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        if part[i] != left or (j := after[i]) >= n or part[j] != right:
            continue
        both = left + right
        part[i], part[j] = both, ""
        merges += 1
        j = after[i] = after[j]
        if j < n:
            before[j] = i
            if (r := get(both + part[j])) is not None:
                heappush(heap, (r, i, both, part[j]))
        if (h := before[i]) >= 0 and (r := get(part[h] + both)) is not None:
            heappush(heap, (r, h, part[h], both))
    return merges


class WordCounts(dict):
    """Token count of a word, found by merging when it is first asked for."""

    def __init__(self, ranks: dict[str, float], single: frozenset[str]) -> None:
        super().__init__()
        self.ranks, self.single = ranks, single

    def __missing__(self, word: str) -> int:
        single = self.single
        extra = sum(len(c.encode()) - 1 for c in word if c not in single)
        count = self[word] = len(word) + extra - count_merges(word, self.ranks) if word else 0
        return count


def counter(path: str) -> Callable[[str | None], int]:
    """A function from text to token count, as the model's own library counts it."""
    ranks, single, inside = merge_table(path)
    counts = WordCounts(ranks, single)
    split_lines = "\n" not in inside and "\n" not in single
    runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def of(text: str | None) -> int:
        if not text:
            return 0
        if len(counts) > CACHE_WORDS:
            counts.clear()
        marked = SPACE + text.replace(" ", SPACE)
        breaks = 0
        if split_lines and "\n" in marked:
            # A line feed is one byte token and no piece crosses it.
            breaks = marked.count("\n")
            lines = marked.split("\n")
        else:
            lines = [marked]
        total = breaks
        for line in lines:
            if SPACE + SPACE in line:
                total += sum(map(counts.__getitem__, runs.findall(line)))
            else:
                first, *words = line.split(SPACE)
                total += counts[first] + sum([counts[SPACE + w] for w in words])
        return total

    return of


_COUNTERS: dict[str, Callable[[str | None], int]] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Token count of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty
    result. One narrow pass, no shuffle; a worker remembers at most
    ``CACHE_WORDS`` words.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = counter(model_path)
        of = _COUNTERS[model_path]
        texts = rows.column("text").to_pylist()
        tokens = [of(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_batch(
        docs.select("doc_id", "text"), batch, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
