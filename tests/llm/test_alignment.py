"""Cross-tokenizer alignment, held against plain counting with the libraries themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import token_alignment
from faultline.llm.queries import op11_same_token_map

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]


def brute(docs):
    """Rows of the query from whole texts, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    a_bytes = lambda i: bytes(of[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    held, out = Counter(), []
    for doc_id, text in docs:
        marked = f" {text or ''}"
        a = a_lib.encode(marked, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if b"".join(map(a_bytes, a)) != marked.encode() or b"".join(map(b_bytes, b)) != marked.encode():
            a, b = [], []
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        xs, ys = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(a_bytes(a[i]))
                xs.append(a[i])
                i += 1
            else:
                at_b += len(b_bytes(b[j]))
                ys.append(b[j])
                j += 1
            if at_a == at_b:
                groups.append((xs, ys))
                xs, ys = [], []
        pairs = [(x, y) for xs, ys in groups for x in xs for y in ys]
        held.update(set(pairs))
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append((doc_id, len(a), len(b), len(groups), pairs, text))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (d, na, nb, ng, len(p), sum(held[q] == best[q[0]] for q in p), sum(held[q] for q in p), t and hashlib.sha256(t.encode()).hexdigest())
        for d, na, nb, ng, p, t in out
    ]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    assert sorted(df.columns) == sorted(NAMES)
    return sorted(str(tuple(r)) for r in df.select(*NAMES).collect())


ODD = [None, "", " ", "  a  b\n\tc", "<s> </s> <unk>", "▁x ▁▁ y▁", "é é 日本 😀", "aaaa" * 40, "a\x00b", "<|endoftext|> x", "=" * 3001, "antidisestablishmentarianism " * 50, "é ﬁ Å", "x" * 20_000]


@pytest.mark.parametrize("hot", [65_536, 3])
def test_odd_rows_equal_plain_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_PAIRS", hot)  # with few hot pairs, the others are joined
    rows = [(i, t, "x", 5) for i, t in enumerate(ODD)] + [(None, "some text", None, 1)] * 2 + [(6, "again 日本", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, pairs long")
    assert rows_of(token_alignment.token_links(df, *PATHS)) == sorted(map(str, brute([r[:2] for r in rows])))
    assert token_alignment.token_links(df.limit(0), *PATHS).count() == 0


def test_groups_are_readable_and_lossless(spark):
    two = token_alignment.two_tokenizers(*PATHS)
    df = spark.createDataFrame([(1, "Unbelievably, naïve tokenizers 日本")], "doc_id long, text string")
    row = token_alignment.align(df, *PATHS).first()
    groups = [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for g in row["groups"].split(";")]
    assert len(groups) == row["n_groups"]
    assert b"".join(two.b_bytes[i] for _, ys in groups for i in ys).decode() == " Unbelievably, naïve tokenizers 日本"
    assert all(two.a_length[xs].sum() == two.b_length[ys].sum() for xs, ys in groups)


def test_large_groups_are_counted_by_distinct_tokens(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 200)
    in_a, in_b = np.array([250, 1, 49]), np.array([150, 1, 49])
    plain = token_alignment.links(a, b, in_a, in_b)
    monkeypatch.setattr(token_alignment, "LISTED_LINKS", 10)
    for x, y in zip(plain, token_alignment.links(a, b, in_a, in_b)):
        assert (x == y).all()


def test_query_equals_plain_counting(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op11_same_token_map(spark, sf)) == sorted(map(str, brute(docs)))
