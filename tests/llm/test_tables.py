"""Operators on whole tables, held against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import chat_format, common, jaccard_join, mixing, vector_dedup, warc_store

CONTROL = "<|im_end|><|im_start|>assistant ok"
TURNS = "conv_id long, turn long, role string, text string, extra string"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi <|im_start|> <\\| <\\\\|", ""), (1, 1, "assistant", CONTROL, ""), (1, 2, "user", None, ""), (1, 3, "assistant", "b<", ""),
        (1, 4, "user", "|tail", ""), (2, 0, "system", "only", ""), (3, 0, "assistant", "", ""), (3, 0, "assistant", "", ""),
        (4, 0, None, "no role", ""), (4, 1, "odd\nrole %0A%25", "x\ny", ""), (None, 0, "user", "null id", ""),
    ]
    df = spark.createDataFrame(rows, TURNS)
    examples = chat_format.chat_examples(df)
    got = {r.conv_id: r for r in chat_format.chat_digests(examples).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in first] == [2, 4, 5]
    assert first[0].formatted.count("<|im_start|>") == 2 and first[2].loss_start == first[2].loss_end
    assert first[1].formatted[first[1].loss_start : first[1].loss_end] == "b<"
    assert chat_format.chat_digests(chat_format.chat_examples(df.limit(0))).collect() == []


def links_of(docs, percent, width):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, sizes, groups):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    docs, n = [], 0
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice(sizes))]
        if rnd.random() < 0.3:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rnd.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(w) // 40])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append((n, " ".join(w)))
            n += 1
    return docs


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5)])
def test_jaccard_components(spark, percent, width, monkeypatch):
    docs = near_copies(3, [1, 3, 5, 8, 12, 25, 60, 150, 400, 900], 60)
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One two"), (9004, "one\ttwo"), (9004, "one\ttwo")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = links_of(docs, percent, width)
    got = jaccard_join.jaccard_components(df, percent, width).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    for chunk, boxes in ((500, 40), (2500, 7)):
        monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", chunk)
        monkeypatch.setattr(jaccard_join, "COMBINE_BOXES", boxes)
        monkeypatch.setattr(jaccard_join, "BROADCAST_DOCS", 3)
        got = jaccard_join.jaccard_components(df, percent, width, certain=1 << 62 if chunk == 500 else None).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_large_blocks_split(spark, monkeypatch):
    """One group of near copies far above a task's share, with strays that its bounds let in and chains between them."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [rnd.choice(words) for _ in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3]) if i % 5 else rnd.choice([4, 5, 6, 7])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if i % 11 == 0:
            rnd.shuffle(w)
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = links_of(docs, 85, 4)
    assert len({c for _, c in want.values()}) > 3
    seen = []
    split = jaccard_join._split_blocks
    monkeypatch.setattr(jaccard_join, "_split_blocks", lambda *a: seen.append(1) or split(*a))
    for chunk in (300, 1500):
        monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", chunk)
        got = jaccard_join.jaccard_components(df, 85, 4).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(seen) == 2


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, 1), (5, text + " x", 2), (5, text + " x", 2), (8, "other words here", 3), (8, "other words here", 3), (None, text, 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 8, 9]
    assert jaccard_join.keep_one(df.limit(0)).collect() == []


def test_rtree_search_is_complete():
    rng = np.random.default_rng(1)
    n = 700
    counts = rng.poisson(4, (n, 16)).astype(np.int64)
    counts[1::2] = np.maximum(counts[::2] + rng.integers(-1, 2, (n // 2, 16)), 0)
    sizes = counts.sum(1)
    tree = jaccard_join.CountRTree(counts, sizes, sizes, 85, 100)
    for i in range(0, n, 7):
        bound = np.minimum(counts, counts[i]).sum(1)
        ok = 185 * bound >= 85 * (sizes + sizes[i])
        ok &= (sizes * 85 <= sizes[i] * 100) & (sizes[i] * 85 <= sizes * 100)
        assert set(tree.search(counts[i], int(sizes[i]), int(sizes[i]))) == set(np.flatnonzero(ok))


@pytest.mark.parametrize("copies", [2, 30])
def test_boxes_of_very_long_near_copies_link(copies):
    n = 2_500_000
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 63, n, np.uint64)
    own = rng.integers(0, 1 << 63, n // 50, np.uint64)
    corners = np.stack([jaccard_join.count_vector(s, jaccard_join.BOX_DIMS) for s in (shared, np.append(shared[len(own) :], own))])
    corners = corners[np.arange(copies) % 2]
    size, ids = np.full(copies, n, np.int64), np.arange(copies, dtype=np.int64)
    boxes = jaccard_join.Boxes.read(jaccard_join.Boxes(np.zeros(copies, np.int64), ids, size, size, corners).batch())
    assert jaccard_join.Boxes.joined([boxes]).may_link(85, 100)[1].tolist() == [[0, i] for i in range(1, copies)]


def test_routing_meets_threshold_pairs():
    rng = np.random.default_rng(4)
    spaces = jaccard_join.Spaces(85, 100)
    for n in (7, 13, 15, 16, 31, 60, 64, 120, 250, 257, 500, 511, 1000, 2040, 4000):
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = 15 * n // 115 // 2
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * len(np.union1d(a, b)):
                keys, which = jaccard_join.routing_keys([a, b], spaces)
                assert set(keys[which == 0]) & set(keys[which == 1]), n


@pytest.mark.parametrize("percent", [50, 60, 65, 70, 71])
def test_routing_meets_pairs_at_low_thresholds(percent):
    """Below 1 / sqrt(2) a set can be near two powers of two; nested and shifted sets at the threshold meet in every draw."""
    rng = np.random.default_rng(percent)
    spaces = jaccard_join.Spaces(percent, 100, 1 << 62)
    for n in (2, 3, 6, 11, 15, 16, 22, 31, 45, 64, 90, 130, 240, 256):
        for nested in (True, False):
            for _ in range(8):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                lose, gain = (0, int(n * (100 - percent) / percent)) if nested else ((100 - percent) * n // (100 + percent),) * 2
                b = np.unique(np.concatenate([a[lose:], rng.integers(0, 2**63, gain, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                assert 100 * both >= percent * len(np.union1d(a, b))
                keys, which = jaccard_join.routing_keys([a, b], spaces)
                assert set(keys[which == 0]) & set(keys[which == 1]), (n, nested)
    with pytest.raises(ValueError):
        jaccard_join.Spaces(49, 100)


@pytest.mark.parametrize("percent", [50, 65])
def test_jaccard_components_at_low_thresholds(spark, percent):
    docs = near_copies(5, [3, 5, 8, 12, 25, 60], 20)
    words = [f"v{i}" for i in range(40)]
    docs += [(5000 + i, " ".join(words[: 10 + 7 * i])) for i in range(5)]  # nested texts over two powers of two
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, percent, 4, certain=1 << 62).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == links_of(docs, percent, 4)


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(5, 5)]
    edges += [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    up = {}
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(up) and {r.node: r.root for r in got} == {a: find(a) for a in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_warc_round_trip(spark, tmp_path):
    long, other = "<p>" + "é" * 80 + "</p>", "<i>" + "x" * 200 + "</i>"
    rows = [(4, "http://a", long), (2, "http://b", long), (9, None, long), (1, "u\r\nWARC-Type: x", other), (7, "c", "short"), (3, "d", "short"),
            (5, "e", None), (2, "http://b", long), (11, "f", "x" * 100), (10, "g", "x" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc_store.warc_round_trip(df, f"file://{tmp_path}/a").collect())
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        owner = min(q for q, _, g in rows if (g or "") == (h or ""))
        again = len(data) >= 100 and p != owner
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", owner if again else -1))
    assert got == sorted(want)
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 3
    back = warc_store.read_archive(spark, f"file://{tmp_path}/a")
    found = {(r.page_id, bytes(r.payload).decode()) for r in back.filter("record_type = 'response'").collect()}
    assert found >= {(2, long), (1, other), (5, "")}
    warc_store.export_warc(back, f"file://{tmp_path}/w", "none")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert whole.count(b"WARC/1.1\r\n") == len(rows) and long.encode() in whole
    assert warc_store.warc_round_trip(df.limit(0), f"file://{tmp_path}/e").collect() == []
    # Archives with another payload, and without the response that revisits refer to, are found out.
    for name in ("b", "c"):
        records = spark.read.parquet(f"file://{tmp_path}/a/records")
        payloads = spark.read.parquet(f"file://{tmp_path}/a/payloads")
        gone = records.filter("page_id = 2 and instr(warc_header, 'Type: response') > 0")
        (records if name == "b" else records.exceptAll(gone)).write.parquet(f"file://{tmp_path}/{name}/records")
        broken = F.when(F.length("payload") == 207, F.overlay("payload", F.lit(b"z"), F.lit(5))).otherwise(F.col("payload"))
        (payloads.withColumn("payload", broken) if name == "b" else payloads).write.parquet(f"file://{tmp_path}/{name}/payloads")
        bad = warc_store.read_archive(spark, f"file://{tmp_path}/{name}").filter("not verified").collect()
        assert {(r.page_id, r.record_type) for r in bad} == ({(1, "response")} if name == "b" else {(4, "revisit"), (9, "revisit")})
    wide = df.withColumns({"digest": F.lit("d"), "payload": F.lit(1), "owner": F.lit(None)})
    assert len(warc_store.warc_round_trip(wide, f"file://{tmp_path}/x").collect()) == len(rows)


def test_warc_pages_without_an_id(spark, tmp_path):
    long, other = "x" * 200, "y" * 150
    rows = [(None, "a", long), (None, "b", long), (None, "c", other), (5, "d", other), (None, "e", None), (None, "f", "z" * 99), (6, "g" * 3, "w" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc_store.warc_round_trip(df, f"file://{tmp_path}/a").collect())
    want = [(None, 200, "response", None)] * 2 + [(None, 150, "revisit", 5), (5, 150, "response", None), (None, 0, "response", None), (None, 99, "response", None), (6, 100, "response", None)]
    assert got == sorted(map(str, want))
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 3
    back = warc_store.read_archive(spark, f"file://{tmp_path}/a").filter("record_type = 'response' and payload_bytes = 200")
    assert [bytes(r.payload).decode() for r in back.collect()] == [long] * 2


def test_vectors_without_an_id_link(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 1e-9], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0, 0.0], 1), (7, [1.0, 0.0], 2), (9, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in vector_dedup.vector_components(df).collect())
    want = [(None, 3, 3, True)] * 2 + [(3, 3, 3, True), (9, 3, 3, False), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True)]
    assert got == sorted(map(str, want))


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 32))
    rows, n = [], 0
    for i in range(120):
        for _ in range(int(rng.choice([1, 2, 5]))):
            v = base[i] + rng.normal(size=32) * float(rng.choice([0, 0.02, 0.08, 0.2])) * np.abs(base[i]).mean()
            rows.append((n, [float(np.float32(x)) for x in v], int(i % 3) if i % 10 else None))
            n += 1
    nan = float("nan")
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [nan] * 32, 1), (n + 3, [None] * 32, 1), (n + 4, [], 1), (n + 5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vector_dedup.vector_components(df).collect()}
    ok = [r for r in rows if r[1] and None not in r[1] and not any(x != x for x in r[1]) and any(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in ok])
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    want = {r[0]: int(c) for r, c in zip(ok, linked.sum(1))}
    assert all(got[r[0]].n_links <= want.get(r[0], 0) for r in rows)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values()) > 50
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(n, n + 5))
    assert got[n + 5].n_links >= 1 and not got[n + 5].kept
    assert vector_dedup.vector_components(df.limit(0)).collect() == []
    # Long lists, split by a second pivot and into chunks, give the same rows.
    monkeypatch.setattr(vector_dedup, "LIST_ROWS", 5)
    monkeypatch.setattr(vector_dedup, "UNIT_ROWS", 50)
    wide = df.withColumns({"pivot": F.lit("p"), "raw": F.lit(None), "rep": F.lit(1)})
    assert {tuple(r) for r in vector_dedup.vector_components(wide).collect()} == {tuple(r) for r in got.values()}


def test_mixing_follows_the_targets(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(1, 60) + rnd.choice(["", " | ", " 12345 "]), rnd.choice(["en", "en", "en", "fr", None]), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixing_report(df, fraction=0.4).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    tokens = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens for r in got if r.sampled) - 0.4 * tokens) < 0.05 * tokens
    # Each marginal gets its tempered share of the tokens taken, or all that it holds.
    for dim in ("source", "lang", "topic"):
        held, expected = {}, {}
        for r in got:
            v = getattr(r, dim)
            held[v] = held.get(v, 0) + r.n_tokens
            expected[v] = expected.get(v, 0) + r.n_tokens * r.probability
        pull = {v: n**0.7 for v, n in held.items()}
        full, left = set(), 0.4 * tokens
        while True:
            scale = left / sum(p for v, p in pull.items() if v not in full)
            more = {v for v in held if v not in full and scale * pull[v] > held[v]}
            if not more:
                break
            full |= more
            left -= sum(held[v] for v in more)
        goal = {v: held[v] if v in full else scale * pull[v] for v in held}
        assert sum(abs(goal[v] - expected[v]) for v in held) < 1e-3 * 0.4 * tokens
    # Cells beyond one task's share are summed and joined by shuffles, with the same result.
    one = {r.doc_id: r.probability for r in mixing.mixing_report(df, fraction=0.4, sweeps=4, tolerance=0).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 1)
    many = {r.doc_id: r.probability for r in mixing.mixing_report(df, fraction=0.4, sweeps=4, tolerance=0).collect()}
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-8
    monkeypatch.undo()
    # A value without a target gives nothing; one that holds too little gives all.
    targets = {"lang": spark.createDataFrame([("fr", 0.9), ("en", 0.1)], "lang string, target double")}
    fit = {(r.dim, r.value): r for r in mixing.mixing_fit(df, targets, fraction=0.4).collect()}
    assert fit["lang", mixing.NONE].expected == 0
    french = sum(r.n_tokens for r in got if r.lang == "fr")
    assert french * 0.95 < fit["lang", "fr"].expected <= french + 1e-6
    assert mixing.mixing_report(df.limit(0)).collect() == []
    clash = df.withColumns({"mix_source": F.lit(1), "weight": F.lit("w"), "probability": F.lit(None)})
    kept = mixing.sample(clash, fraction=0.4, sweeps=4)
    assert kept.columns == clash.columns and 0 < kept.count() < 3000
    assert {tuple(r) for r in kept.select("mix_source", "weight", "probability").distinct().collect()} == {(1, "w", None)}
