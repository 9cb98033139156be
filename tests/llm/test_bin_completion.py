"""Bin completion, held against exhaustive search, and its packing against the library's ids."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import bin_completion
from faultline.llm.packing import best_fit_decreasing
from faultline.llm.queries import op12_bin_completion

public_tokenizers = pytest.importorskip("public_tokenizers")


def fewest(lengths, window):
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k, used in enumerate(bins):
            if used + lengths[i] <= window and used not in bins[:k]:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def windows(lengths, seq, offset, window):
    held = {}
    for s, o, n in zip(seq.tolist(), offset.tolist(), lengths.tolist()):
        held.setdefault(s, []).append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    return len(held)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_small_sets_are_packed_best(data):
    window = data.draw(st.sampled_from([7, 10, 20, 50]))
    lengths = np.array(sorted(data.draw(st.lists(st.integers(1, window), max_size=10)), reverse=True), int)
    best = fewest(lengths.tolist(), window)
    assert bin_completion.least_windows(lengths, window) <= best
    seq, offset = bin_completion.bin_completion(lengths, window)
    assert windows(lengths, seq, offset, window) == best


def test_completion_beats_best_fit():
    lengths = np.sort(np.random.default_rng(0).integers(200, 700, 2000))[::-1]
    seq, offset = bin_completion.bin_completion(lengths, 1024)
    assert windows(lengths, seq, offset, 1024) < best_fit_decreasing(lengths, 1024)[0].max() + 1


def test_known_packing_is_an_incumbent_and_many_small_lengths_fit():
    lengths = np.array([6, 5, 4, 4, 3, 2])  # 6+4, 5+3+2, 4
    given_ = np.array([8, 5, 8, 9, 5, 5])
    seq, offset = bin_completion.bin_completion(lengths, 10, given_)
    assert windows(lengths, seq, offset, 10) == 3
    ones = np.array([700] * 40 + [3] * 500 + [1] * 3000)
    seq, offset = bin_completion.bin_completion(ones, 1024)
    assert windows(ones, seq, offset, 1024) == bin_completion.least_windows(ones, 1024)


def test_dominated_fillings_are_left_out():
    left = bin_completion.Fillings([6, 5, 3, 2, 1, 1], 10)
    left.take((6,))
    found = [items for items, _ in left.around(6, 10)]
    assert found == [(3, 1)]  # (2, 1, 1) is 3 cut up; the others leave room for a 1
    left.give((6,))
    assert left.count[6] == 1 and left.present == 0b1101110


def check(rows, docs, window=1024, room=1):
    """Whole ids in pieces as stated, gapless windows; not more windows than the sum needs and ``room``."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        first = n if n <= window else (n - 1) % window + 1
        cuts = [0, *range(first, n + 1, window)]
        want += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    lengths, seq = np.array([r["length"] for r in rows]), np.array([r["sequence_id"] for r in rows])
    n = windows(lengths, seq, np.array([r["offset"] for r in rows]), window)
    assert n <= math.ceil(lengths.sum() / window) + room


def test_packing_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "<|endoftext|> x", "é日😀 " * 900, "word " * 40_000, "x", "x"]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randrange(900))) for _ in range(1500)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "null id", 0, 0)] * 3 + [(4, "again", 0, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, piece long, sequence_id long")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for group in (4096, 256):  # one group, and several levels
        check(bin_completion.pack_completely(df, path, group_pieces=group).collect(), [r[:2] for r in rows])
    assert bin_completion.pack_completely(df.limit(0), path).count() == 0


def test_query_packs_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(op12_bin_completion(spark, sf).collect(), [tuple(r) for r in docs])
