"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, per_batch, stored
from .jaccard_join import Union

#: Reference points: one for every so many distinct vectors, between the bounds. The sample is the only data fitted on.
VECTORS_PER_PIVOT = 32
LEAST_PIVOTS, MOST_PIVOTS = 16, 2048
#: Nearest pivots that describe a vector, and how many of them two vectors must share.
PERMUTATION = 8
SHARED = 2
#: Vectors of one inverted list that a task holds, on either side, and entries of short lists that share a task on average.
LIST_ROWS = 1024
UNIT_ROWS = 20_000

#: What tells inverted lists apart; ``second`` is -1 in a list that is not split.
LIST_KEY = ["label", "dim", "pivot", "second"]

#: Classes of which no row has a vec_id are named from here on, so that any vec_id below is smaller.
UNNAMED = 1 << 62

CLASS_SCHEMA = "vec_id long, label string, digest string, dim int, raw binary"


def raw_type(vectors: DataFrame) -> str:
    """How vectors travel: as they are where their parts are floats, else as doubles."""
    part = vectors.schema["embedding"].dataType.elementType
    return "<f4" if part.typeName() == "float" else "<f8"


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length in double precision, scaled to length 1."""
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    # Divide by the largest part first: very large and very small vectors keep their direction.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classed(vectors: DataFrame) -> DataFrame:
    """Every row with its label as text, and digest, length and parts; these are null where it can't link."""
    kind = raw_type(vectors)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        digests, dims, raws = [], [], []
        for label, v in zip(rows.column("label").to_pylist(), rows.column("embedding").to_pylist()):
            x = None
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                x = x if np.isfinite(x).all() and x.any() else None
            if x is None:
                digests.append(None), dims.append(None), raws.append(None)
            else:
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
                dims.append(len(v))
                raws.append(x.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays(
            [
                rows.column("vec_id"),
                rows.column("label"),
                pa.array(digests, pa.string()),
                pa.array(dims, pa.int32()),
                pa.array(raws, pa.binary()),
            ],
            names=["vec_id", "label", "digest", "dim", "raw"],
        )

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    return per_batch(rows, batch, CLASS_SCHEMA)


def fit_pivots(classes: DataFrame, n: int, kind: str, seed: str = "pivot") -> dict[int, np.ndarray]:
    """At most ``MOST_PIVOTS`` distinct vectors, picked by a hash of their digests, by vector length."""
    want = min(max(n // VECTORS_PER_PIVOT, LEAST_PIVOTS), MOST_PIVOTS)
    picked = classes.select("dim", "raw").orderBy(F.md5(F.concat(F.lit(seed), "digest")), "label").limit(want)
    by: dict[int, list] = {}
    for r in picked.collect():
        by.setdefault(r["dim"], []).append(bytes(r["raw"]))
    return {d: unit_vectors(x, kind) for d, x in by.items()}


def pivots_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """Pivots of one vector length; lengths that the sample lacks get fixed directions."""
    if dim not in pivots:
        pivots[dim] = np.random.default_rng(dim).standard_normal((LEAST_PIVOTS, dim))
    return pivots[dim]


def permutations(classes: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """``classes`` with ``perm``: numbers of the nearest pivots, nearest first."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        dims, raw = np.array(rows.column("dim").to_pylist()), rows.column("raw").to_pylist()
        perms = [None] * len(raw)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            near = -(unit_vectors([raw[i] for i in own], kind) @ pivots_of(pivots, dim).T)
            for i, perm in zip(own.tolist(), np.argsort(near, axis=1, kind="stable")[:, :PERMUTATION].tolist()):
                perms[i] = perm
        names = ["rep", "copies", "label", "dim", "raw"]
        return pa.RecordBatch.from_arrays(
            [rows.column(c) for c in names] + [pa.array(perms, pa.list_(pa.int32()))], names=[*names, "perm"]
        )

    return per_batch(
        classes.select("rep", "copies", "label", "dim", "raw"),
        batch,
        "rep long, copies long, label string, dim int, raw binary, perm array<int>",
    )


def list_links(pivot: int, second: int, rep: np.ndarray, copies: np.ndarray, units: np.ndarray, perm: np.ndarray, side: np.ndarray | None, least: float, shared: int) -> tuple[np.ndarray, list]:
    """Links of one inverted list, or across two chunks of it: how many vectors each one links with, and spanning pairs.

    Vectors that share at least ``shared`` pivots are candidates; a pair is
    counted only in the list of the smallest pivot that both have (of the two
    smallest, where the list has a ``second``), and only if its cosine reaches
    ``least``.
    """
    names, local = np.unique(perm, return_inverse=True)
    have = np.zeros((len(rep), len(names)), np.float32)
    have[np.arange(len(rep))[:, None], local.reshape(perm.shape)] = 1
    need = min(shared, perm.shape[1])
    before = (names < second) & (names != pivot) if second >= 0 else names < pivot
    linked, groups, spans = np.zeros(len(rep), np.int64), Union(len(rep)), []
    for start in range(0, len(rep), 256):
        rows = slice(start, start + 256)
        ok = have[rows] @ have.T >= need
        ok &= ~(have[rows][:, before] @ have[:, before].T > 0)
        if side is None:
            ok &= np.arange(len(rep))[None, :] < np.arange(len(rep))[rows, None]
        else:
            ok &= side[rows, None] & ~side[None, :]
        a, b = np.nonzero(ok)
        a += start
        for cut in range(0, len(a), 100_000):
            x, y = a[cut : cut + 100_000], b[cut : cut + 100_000]
            good = np.einsum("ij,ij->i", units[x], units[y]) >= least
            x, y = x[good], y[good]
            np.add.at(linked, x, copies[y])
            np.add.at(linked, y, copies[x])
            spans += [(int(rep[i]), int(rep[j])) for i, j in zip(x.tolist(), y.tolist()) if groups.join(i, j)]
    return linked, spans


def unit_links(pdf: pd.DataFrame, least: float, shared: int, kind: str) -> pd.DataFrame:
    """Links of all lists that share a task: (a, null, links) for vectors with links and (a, b, 0) for spanning pairs."""
    rep, copies, chunk = (pdf[c].to_numpy() for c in ("rep", "copies", "chunk"))
    raw, perms = pdf["raw"].to_numpy(), pdf["perm"].to_numpy()
    counted, spanning = [], []
    for (_, _, pivot, second, low, high), rows in pdf.groupby([*LIST_KEY, "low", "high"], sort=False).indices.items():
        if len(rows) < 2:
            continue
        side = chunk[rows] == high if low != high else None
        units, perm = unit_vectors(raw[rows], kind), np.stack(perms[rows])
        linked, spans = list_links(int(pivot), int(second), rep[rows], copies[rows], units, perm, side, least, shared)
        counted += [(int(rep[rows[i]]), int(linked[i])) for i in np.flatnonzero(linked)]
        spanning += spans
    return pd.DataFrame(
        {
            "a": [*(a for a, _ in counted), *(a for a, _ in spanning)],
            "b": [None] * len(counted) + [b for _, b in spanning],
            "links": [*(n for _, n in counted), *(0 for _ in spanning)],
        }
    ).astype({"a": "int64", "b": "Int64", "links": "int64"})


def vector_components(vectors: DataFrame, least: float = 0.98, shared: int = SHARED) -> DataFrame:
    """Links of every vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their lengths
    agree and their cosine in double precision is at least ``least``. A
    vector that is null, empty, zero, or holds a null, NaN or infinite part
    links with nothing and is kept. Equal vectors become one class first, so
    a group of copies is one entry of the index; copies count as links.
    Repeated rows are copies. Rows without a vec_id link like any other and
    are kept; their component is the smallest vec_id that they reach (below
    2^62), or null where they reach none. The index may miss pairs that share fewer than
    ``shared`` of their ``PERMUTATION`` nearest pivots (tests measure recall
    against brute force); it never links a pair below ``least``. Inverted
    lists above ``LIST_ROWS`` are split by a second shared pivot; what is
    still longer is cut by hash into chunks, and each pair of chunks is joined
    by a task of its own, so no list is capped. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = stored(classed(vectors))
    valid = rows.filter(F.col("digest").isNotNull())
    unnamed = F.lit(UNNAMED) + F.pmod(F.xxhash64("label", "digest"), F.lit(UNNAMED - 1))
    classes = stored(
        valid.groupBy("label", "digest").agg(
            F.coalesce(F.min("vec_id"), unnamed).alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.first("dim").alias("dim"),
            F.first("raw").alias("raw"),
        )
    )
    kind = raw_type(vectors)
    pivots = fit_pivots(classes, classes.count(), kind)
    index = stored(permutations(classes, pivots, kind))
    posts = index.withColumn("pivot", F.explode("perm"))
    first = LIST_KEY[:3]
    held = stored(posts.groupBy(*first).agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
    posts = posts.join(held, first)
    # A long list is split by a second pivot: two vectors that share the first and no smaller one meet under the next they share.
    later = F.filter("perm", lambda p: p > F.col("pivot"))
    seconds = F.when((F.col("held") > LIST_ROWS) & F.lit(shared >= 2), later).otherwise(F.array(F.lit(-1)))
    posts = posts.withColumn("second", F.explode(seconds)).drop("held")
    sizes = stored(
        posts.groupBy(*LIST_KEY)
        .agg(F.count(F.lit(1)).alias("held"))
        .filter("held > 1")
        .select(*LIST_KEY, "held", F.ceil(F.col("held") / LIST_ROWS).cast("int").alias("chunks"))
    )
    entries = sizes.filter("chunks = 1").agg(F.sum("held")).first()[0] or 0
    posts = posts.join(sizes.drop("held"), LIST_KEY)
    posts = posts.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    posts = posts.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    # Short lists share tasks; a pair of chunks of a long one has its own.
    own = F.xxhash64(*LIST_KEY, "low", "high")
    unit = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64(*LIST_KEY), F.lit(max(1, -(-entries // UNIT_ROWS))))).otherwise(own)
    found = stored(
        posts.select(unit.alias("unit"), *LIST_KEY, "low", "high", "chunk", "rep", "copies", "raw", "perm")
        .groupBy("unit")
        .applyInPandas(lambda pdf: unit_links(pdf, least, shared, kind), "a long, b long, links long")
    )
    groups = components(found.filter(F.col("b").isNotNull())).select(F.col("node").alias("rep"), "root")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = (
        classes.select("label", "digest", "rep", "copies")
        .join(groups, "rep", "left")
        .join(counts, "rep", "left")
        .select(
            "label",
            "digest",
            F.coalesce("root", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        )
    )
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.coalesce(F.when(F.col("root") < UNNAMED, F.col("root")), F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
