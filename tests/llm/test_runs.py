"""Periodic runs of words, held against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import periodic_runs
from faultline.llm.queries import op13_periodic_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w, least=6, exponent=4):
    w, out = list(w), []
    ids = np.unique(w, return_inverse=True)[1] if w else np.zeros(0, int)
    n = len(w)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], ids[q:] == ids[: n - q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for s, e in zip(edges[::2], edges[1::2]):
            e += q
            if e - s >= max(least, exponent * q) and not any(w[s + r : e] == w[s : e - r] for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, rewrite=True):
    words = WORDS.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 8)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(BLOCKS, st.sampled_from([(6, 4), (4, 2), (6, 3), (12, 2)]))
def test_runs_equal_a_search_over_all_periods(blocks, limits):
    word = [w for block, times in blocks for w in block * times]
    assert periodic_runs.runs(word, *limits) == all_runs(word, *limits)


def test_long_words_and_nested_runs():
    rng = random.Random(3)
    word = [rng.randrange(9) for _ in range(200)]
    for _ in range(6):
        cut = rng.randrange(len(word) // 2)
        word += word[cut : cut + rng.randrange(1, 30)] * rng.randrange(1, 9)
    assert periodic_runs.runs(word) == all_runs(word)
    inner = [1] * 7 + [2]
    assert periodic_runs.runs(inner * 5) == all_runs(inner * 5) and len(all_runs(inner * 5)) == 6
    assert periodic_runs.runs([7] * 100_000) == [(0, 100_000, 1)]


def test_frame_of_odd_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " + "a b " * 4 + "c", "A a A a A a A a", "é é " * 9, "w " * 30_000]
    rows = [(i, t, "en", [("clash", 1, 2)], 7) for i, t in enumerate(texts)] + [(None, "b " * 8, "en", [], 7), (3, "a", "en", [], 7)] * 2
    schema = "doc_id long, text string, collapsed string, runs array<struct<a: string, b: long, c: long>>, n_words long"
    df = spark.createDataFrame(rows, schema)
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(df)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(r[0], r[1], rewrite=False)) for r in rows)
    raw = {r["doc_id"]: r for r in periodic_runs.periodic_runs(df).filter("doc_id = 6").collect()}
    assert raw[6]["collapsed"] == "x a b c" and raw[6]["runs"][0].asDict() == {"start": 1, "length": 8, "period": 2}
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    rewritten = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_repetitions(df))).collect()
    assert sorted(map(str, map(tuple, rewritten))) == sorted(str(expected(*r[:2])) for r in rows)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[r["doc_id"]] == expected(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got.values()) > 10
