"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null in a dimension.
NONE = "\u0000null"
#: Cells are raked in one task and broadcast to the documents up to this many, else shuffled and joined.
BROADCAST_CELLS = 50_000
#: Most sweeps, sweeps between two looks at the error, and the share of tokens that may lie wrong.
SWEEPS, BLOCK, TOLERANCE = 24, 4, 1e-3
#: From this part of its tokens on, a cell counts as full.
FULL = 1 - 1e-9


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: a table, a record with long numbers, lines, or prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.regexp_like(text, F.lit(r"[0-9]{4}")), "record")
        .when(F.contains(text, F.lit("\n")), "lines")
        .otherwise("prose")
    )


def uniform(doc_id: Column, seed: str) -> Column:
    """A number from 0 to below 1 that depends on the document's id and the seed alone."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def keyed(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """``docs`` with the columns that mixing needs, under names of its own.

    ``topic`` and ``tokens`` are the corpus's own topic and token count where
    it has them; else they are the form of the text and its words.
    """
    text = F.coalesce("text", F.lit(""))
    topic = topic_of(text) if topic is None else topic
    tokens = F.regexp_count(text, F.lit(WORD)) if tokens is None else F.coalesce(tokens, F.lit(0))
    return docs.withColumns(
        {
            "mix_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
            "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
            "mix_topic": F.coalesce(topic.cast("string"), F.lit(NONE)),
            "mix_tokens": tokens.cast("long"),
        }
    )


def marginals(cells: DataFrame, targets: dict[str, DataFrame] | None, power: float) -> DataFrame:
    """(dim, value, held, pull): the tokens of every value of a dimension, and what its target is proportional to.

    ``targets`` maps a dimension to a frame of (dimension, target); a value
    without a target pulls nothing. Without targets a value pulls its tokens
    to ``power``.
    """
    parts = []
    for d in DIMS:
        m = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("held"))
        target = (targets or {}).get(d)
        if target is None:
            m = m.withColumn("pull", F.pow("held", F.lit(power)))
        else:
            key = F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias("value")
            m = m.join(target.select(key, F.col("target").cast("double").alias("pull")), "value", "left")
        parts.append(m.select(F.lit(d).alias("dim"), "value", "held", F.coalesce("pull", F.lit(0.0)).alias("pull")))
    return stored(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def goals(margins: DataFrame, fraction: float, rounds: int = 12) -> tuple[DataFrame, float]:
    """(dim, value, goal) and the tokens that the goals of a dimension sum to.

    A goal is proportional to the value's pull but at most what the value
    holds; each round hands what full values can't take to the others. The
    driver sees three rows of sums in a round.
    """
    sums = margins.groupBy("dim").agg(
        F.sum("held").alias("held"),
        F.sum(F.when(F.col("pull") > 0, F.col("held"))).alias("within"),
        F.sum("pull").alias("pull"),
    )
    sums = {r["dim"]: r for r in sums.collect()}
    wanted = min((min(fraction * r["held"], r["within"] or 0.0) for r in sums.values()), default=0.0)
    scale = {d: wanted / r["pull"] if r["pull"] else 0.0 for d, r in sums.items()}

    def scaled() -> Column:
        factor = F.lit(0.0)
        for d, x in scale.items():
            factor = F.when(F.col("dim") == d, F.lit(x)).otherwise(factor)
        return F.col("pull") * factor

    for _ in range(rounds):
        full = scaled() >= F.col("held") * FULL
        left = margins.groupBy("dim").agg(
            F.sum(F.when(full, F.col("held")).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("pull"))).alias("pull"),
        )
        new = {r["dim"]: (wanted - r["full"]) / r["pull"] if r["pull"] > 0 else scale[r["dim"]] for r in left.collect()}
        settled = all(abs(x - scale[d]) <= 1e-12 * scale[d] for d, x in new.items())
        scale = new
        if settled:
            break
    return margins.select("dim", "value", F.least("held", scaled()).alias("goal")), wanted


def with_sums(cells: DataFrame, dim: str, sums: dict[str, str], few: bool) -> DataFrame:
    """``cells`` with sums of expressions over all cells that share their value of ``dim``.

    Few cells are one partition, so a window needs no shuffle. More are
    summed in each task first, and the sums are joined back.
    """
    if few:
        return cells.selectExpr("*", *(f"sum({c}) OVER (PARTITION BY {dim}) AS {k}" for k, c in sums.items()))
    return cells.join(cells.groupBy(dim).agg(*(F.expr(f"sum({c})").alias(k) for k, c in sums.items())), dim)


def rake(cells: DataFrame, goal: DataFrame, wanted: float, few: bool, sweeps: int, tolerance: float) -> DataFrame:
    """``cells`` with ``weight``: tokens to take, at most those that the cell holds.

    Each sweep fits every dimension's sums to its goals in turn: a value above
    its goal shrinks, one below grows in the cells that still hold more. The
    sweeps end when, in every dimension, the sums differ from the goals by at
    most ``tolerance`` of all tokens taken; that is looked at every ``BLOCK``
    sweeps where cells are few. Goals that no weights meet are
    approached until the sweeps are used up.
    """
    for d in DIMS:
        own = goal.filter(F.col("dim") == d).select(F.col("value").alias(d), F.col("goal").alias(f"goal_{d}"))
        cells = cells.join(F.broadcast(own) if few else own, d)
    share = wanted / (cells.agg(F.sum("tokens")).first()[0] or 1)
    out = cells.withColumn("weight", F.col("tokens") * F.lit(share))
    block, fixed = BLOCK if few else 1, cells.columns
    for _ in range(0, sweeps, block):
        out = out.coalesce(1) if few else out
        for d in DIMS * block:
            full = f"CASE WHEN weight >= tokens * {FULL!r}D THEN weight ELSE 0D END"
            grow = f"greatest(1D, coalesce((goal_{d} - full) / nullif(sum - full, 0D), 1D))"
            shrink = f"coalesce(goal_{d} / nullif(sum, 0D), 1D)"
            factor = f"CASE WHEN goal_{d} > sum THEN {grow} ELSE {shrink} END"
            out = with_sums(out, d, {"sum": "weight", "full": full}, few)
            out = out.selectExpr(*fixed, f"least(CAST(tokens AS DOUBLE), weight * {factor}) AS weight")
        out = stored(out)
        if marginal_error(out, wanted, few) <= tolerance:
            break
    return out


def marginal_error(cells: DataFrame, wanted: float, few: bool) -> float:
    """The largest share of the tokens taken, over the dimensions, by which the sums differ from the goals."""
    off = {}
    cells = cells.coalesce(1) if few else cells
    for d in DIMS:
        cells = with_sums(cells, d, {f"sum_{d}": "weight"}, few)
        own = F.abs(F.col(f"sum_{d}") - F.col(f"goal_{d}")) * F.col("weight") / F.nullif(f"sum_{d}", F.lit(0.0))
        off[d] = F.sum(own).alias(d)
    found = cells.agg(*off.values()).first()
    return max((x or 0.0) for x in found) / wanted if wanted else 0.0


def calibrated_cells(
    rows: DataFrame,
    targets: dict[str, DataFrame] | None,
    power: float,
    fraction: float,
    sweeps: int,
    tolerance: float,
) -> tuple[DataFrame, bool]:
    """Cells with goals, weight and probability, and whether they are few."""
    cells = stored(
        rows.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMS)).agg(F.sum("mix_tokens").alias("tokens"))
    )
    few = cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    goal, wanted = goals(marginals(cells, targets, power), fraction)
    raked = rake(cells, goal, wanted, few, sweeps, tolerance)
    p = F.coalesce(F.col("weight") / F.nullif("tokens", F.lit(0)), F.lit(0.0))
    return raked.withColumn("probability", F.round(p, 9)), few


def mixing_fit(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.7, fraction: float = 0.5, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(dim, value, goal, expected): the tokens that each marginal should and will get, to see what could not be met."""
    cells, _ = calibrated_cells(keyed(docs), targets, power, fraction, sweeps, tolerance)
    parts = [
        cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(
            F.first(f"goal_{d}").alias("goal"), F.sum("weight").alias("expected")
        )
        for d in DIMS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def mixed(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    power: float = 0.7,
    fraction: float = 0.5,
    sweeps: int = SWEEPS,
    tolerance: float = TOLERANCE,
    seed: str = "mix",
    topic: Column | None = None,
    tokens: Column | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with source, language and topic raked to targets and a sampling decision for each row.

    Token weights are summed by (source, lang, topic) and raked until the
    sums of the three marginals meet their goals, no cell giving more than it
    holds. Goals follow ``targets`` (default: the corpus's own tokens to the
    ``power``) and sum to ``fraction`` of all tokens. A cell's weight over its
    tokens is the probability of its rows. A row is sampled when a hash of its
    doc_id is below it, so a run can be repeated, and rows that repeat a
    doc_id in one cell share its fate. Nulls in a dimension are a value of
    their own; a null text has no tokens; a row of a cell without tokens is
    not sampled; columns of ``docs`` must not be named like those added; an
    empty table gives no rows.

    Only the sums by cell are shuffled. The cells, whose count is checked, are
    broadcast to the documents, or joined by a shuffle beyond
    ``BROADCAST_CELLS``. Adds mix_source, mix_lang, mix_topic, mix_tokens,
    weight, probability, sampled.
    """
    rows = keyed(docs, topic, tokens) if rows is None else rows
    cells, few = calibrated_cells(rows, targets, power, fraction, sweeps, tolerance)
    cells = cells.select(*(F.col(d).alias(f"mix_{d}") for d in DIMS), "weight", "probability")
    joined = rows.join(F.broadcast(cells) if few else cells, [f"mix_{d}" for d in DIMS], "left")
    p = F.coalesce("probability", F.lit(0.0))
    return joined.withColumn("probability", p).withColumn("sampled", uniform(F.col("doc_id"), seed) < p)


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, source, lang, topic, n_tokens, probability, sampled."""
    slim = stored(keyed(docs).select("doc_id", "source", "lang", *(f"mix_{d}" for d in DIMS), "mix_tokens"))
    out = mixed(slim, rows=slim, **options)
    return out.select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        "probability",
        "sampled",
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns, whatever their names; nulls and ties as ``mixed`` says."""
    # The row travels as one column, so none of its names can clash with those of the mixing.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    return mixed(rows, **options).filter("sampled").select("row.*")
