"""Periodic runs of words: a suffix automaton whose last occurrences are recoloured through link-cut paths."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words in the grams whose recurrence picks the stretches that can hold a run.
GRAM = 3
RUN = "struct<start: long, length: long, period: long>"


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length) of every state and the state of every prefix of ``word``."""
    step, link, length, ends, last = [{}], [-1], [0], [], 0
    for c in word:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        ends.append(new)
        last = new
    return link, length, ends


class LastOccurrences:
    """Paths of the suffix-link tree in splay trees; all states of a path last occurred at the same position.

    The colour of a path (that position, -1 for none) stands at the root of
    its splay tree; ``up`` is the parent in it or, at its root, the link that
    leads out of the path.
    """

    def __init__(self, link: list[int]) -> None:
        n = len(link)
        self.up, self.low, self.high, self.colour = list(link), [-1] * n, [-1] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, low, high, colour = self.up, self.low, self.high, self.colour
        p = up[x]
        while p >= 0 and (low[p] == x or high[p] == x):
            g = up[p]
            inner = g >= 0 and (low[g] == p or high[g] == p)
            # Turn the parent first where both lie on one side, else x twice.
            for y in ((p, x) if (low[p] == x) == (low[g] == p) else (x, x)) if inner else (x,):
                q = up[y]
                r = up[q]
                if low[q] == y:
                    c = low[q] = high[y]
                    high[y] = q
                else:
                    c = high[q] = low[y]
                    low[y] = q
                if c >= 0:
                    up[c] = q
                up[q], up[y] = y, r
                if r >= 0:
                    if low[r] == q:
                        low[r] = y
                    elif high[r] == q:
                        high[r] = y
                    else:
                        colour[y] = colour[q]
                else:
                    colour[y] = colour[q]
            p = up[x]

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``state`` with ``end``; (former colour, deepest state) of its segments."""
        up, high, colour, splay = self.up, self.high, self.colour, self._splay
        segments, below, x = [], -1, state
        while x >= 0:
            splay(x)
            segments.append((colour[x], x))
            if (deeper := high[x]) >= 0:
                colour[deeper] = colour[x]
            high[x] = below
            below, x = x, up[x]
        colour[below] = end
        splay(state)
        return segments


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches (start, end exclusive) outside which no run can lie.

    In a run of period q every gram after the first q words occurred before,
    at most q words back, and a run has at least ``exponent`` periods, so the
    grams of a stretch have to recur within a part of its length.
    """
    q = least // exponent
    fewest = min(max(least, exponent * p) - p for p in (max(q, 1), q + 1))  # words of a run after its first period
    size_of_gram = min(GRAM, fewest)
    n = len(ids) - size_of_gram + 1
    if len(ids) < least:
        return []
    gram = ids[:n].astype(np.uint64)
    for k in range(1, size_of_gram):  # a hash: equal hashes of other grams only add stretches
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + ids[k : n + k].astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    back = np.full(n, len(ids) + 1, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found, todo = [], [(0, n)]
    while todo:
        low, high = todo.pop()
        size = high - low
        # A run of period q gives length - q - size_of_gram + 1 such grams in a row.
        most = (size + size_of_gram - 1) // (exponent - 1)
        if size < fewest - size_of_gram + 1:
            continue
        good = np.flatnonzero(back[low:high] <= most) + low
        if not len(good):
            continue
        cuts = np.flatnonzero(np.diff(good) > 1)
        first, last = np.append(good[0], good[cuts + 1]), np.append(good[cuts], good[-1])
        if len(first) == 1 and last[0] - first[0] + 1 == size:
            found.append((max(0, low - most), high + size_of_gram - 1))
        else:
            todo += [(int(a), int(b) + 1) for a, b in zip(first.tolist(), last.tolist())]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def runs(word: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs of ``word`` as (start, length, smallest period), in order.

    A run is a maximal stretch with smallest period q that has at least
    ``max(least, exponent * q)`` words, ``exponent`` being 2 or more. Every
    word of a stretch that can hold one recolours its path in the automaton; a
    segment last seen d words back whose states are at least d words long is a
    square, and so part of a run.
    """
    found, n = set(), len(word)
    for low, high in stretches(np.array(word, np.int64), least, exponent):
        link, length, ends = suffix_automaton(word[low:high])
        access, known = LastOccurrences(link).access, {}
        for at, state in enumerate(ends):
            for before, deepest in access(state, at):
                d = at - before
                if before < 0 or d > length[deepest] or known.get(d, -1) >= at:
                    continue
                start, end = low + at - 2 * d + 1, low + at
                while start and word[start - 1] == word[start - 1 + d]:
                    start -= 1
                while end + 1 < n and word[end + 1] == word[end + 1 - d]:
                    end += 1
                known[d] = end - low
                if end - start + 1 >= max(least, exponent * d):
                    found.add((start, end - start + 1, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """Runs of words in every whole text of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    ``runs`` is an array of (start, length, period) in words, by start, then
    period; ``collapsed`` is the text without the repetitions, its words
    joined by one space. A null, empty or wordless text has no runs and
    collapses to nothing. Repeated rows and null doc_ids give a row each; runs
    that overlap are all listed; other columns are ignored; an empty table
    gives no rows. A narrow pass without a shuffle; a document is one task's
    work, in time and memory that grow with its words times a logarithm.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts, all_runs, texts = [], [], []
        for text in rows.column("text").to_pylist():
            words = WORD.findall(text or "")
            number: dict[str, int] = {}
            found = runs([number.setdefault(w, len(number)) for w in words], least, exponent)
            if found:
                words_left = [w for w, keep in zip(words, kept_words(len(words), found).tolist()) if keep]
            else:
                words_left = words
            counts.append(len(words))
            all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            texts.append(" ".join(words_left))
        run = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(run)), pa.array(texts, pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )

    return per_batch(docs.select("doc_id", "text"), batch, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length/period, compared exactly; of ties the first by start, then period."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(
        found,
        none,
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of the rows of :func:`periodic_runs`."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repetitions(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which every tenth document repeats itself from some word on.

    With h the CRC-32 of the decimal doc_id: where h is divisible by ten and
    the text has words, each word from a = g % n on is replaced by the word
    at a + (i - a) % p, where g = h div 10 and p = 1 + (n - a) div (3 + g % 8).
    A null doc_id has no h; its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = rows.withColumn("words", F.when(F.col("chosen"), words)).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform("words", lambda _, i: F.get("words", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))
