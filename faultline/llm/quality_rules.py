"""Host-level quality rules with an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host's rule failures count from this many rejected hosts on through a shuffled join.
BROADCAST_HOSTS = 50_000
#: Rows that a prior weighs as at most.
MOST_WEIGHT = 1e6


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """``STATS`` of one text; all 0 for null or a text without words."""
    raw = (text or "").encode()
    words = raw.split()  # on bytes: exactly U+0020 and U+0009-000D
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0
    inside = raw.translate(None, SPACES)
    code_points = len(inside.decode())
    symbols = len(inside) - len(inside.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else ()
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        hit = bytearray(len(words))
        for i in compress(range(len(windows)), [count[w] > 1 for w in windows]):
            hit[i] = hit[i + 1] = hit[i + 2] = 1
        repeated = sum(hit)
    return len(words), code_points, symbols, len(lines) - len(set(lines)), repeated


def _stats_batch(batch: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    found = [text_stats(t) for t in batch.column("text").to_pylist()]
    columns = list(zip(*found)) or [()] * len(STATS)
    arrays = [batch.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *STATS])


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with the ``STATS`` of its ``text``."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    longs = ", ".join(f"{c} long" for c in STATS)
    need = list(dict.fromkeys([*keep, "text"]))
    return per_batch(docs.select(*need), lambda b: _stats_batch(b, keep), f"{fields}, {longs}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Boolean rules whose failures are counted for each host."""
    return {
        "short": F.col("n_words") < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
    }


def host_verdicts(stats: DataFrame, max_rate: float = 0.5, sds: float = 2.0) -> DataFrame:
    """Hosts with their shrunk failure rate for each rule and a verdict.

    ``stats`` has ``source`` and the rule columns' inputs. For each rule, a
    beta prior is fitted to the hosts' raw rates by moments (mean, and the
    variance less that of sampling, one row of figures); a host's rate is its
    posterior mean. A host
    is rejected when, for some rule, posterior mean less ``sds`` posterior
    standard deviations exceeds ``max_rate``. A null source is no host. A
    single host, or hosts that all agree, get a prior of weight 2 around the
    mean; hosts that differ no more than chance makes them get the mean as
    their rate (weight ``MOST_WEIGHT``). No rows give no hosts.
    """
    rules = rule_failures()
    counted = stored(
        stats.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), *(F.count_if(r).alias(f"f_{k}") for k, r in rules.items()))
    )
    rates = [F.col(f"f_{k}") / F.col("n") for k in rules]
    moments = counted.agg(
        *(F.avg(r).alias(f"m{i}") for i, r in enumerate(rates)),
        *(F.var_pop(r).alias(f"v{i}") for i, r in enumerate(rates)),
        F.avg(1 / F.col("n")).alias("noise"),
    ).first()
    out, rejected = counted, F.lit(False)
    for i, k in enumerate(rules):
        mean = min(max(moments[f"m{i}"] or 0.0, 1e-3), 1 - 1e-3)
        # Small hosts' rates scatter by chance alone; only what is beyond that tells hosts apart.
        var = (moments[f"v{i}"] or 0.0) - mean * (1 - mean) * (moments["noise"] or 0.0)
        weight = mean * (1 - mean) / var - 1 if var > 0 else MOST_WEIGHT if moments[f"v{i}"] else 2.0
        weight = min(max(weight, 2.0), MOST_WEIGHT)
        a = F.lit(mean * weight) + F.col(f"f_{k}")
        total = F.lit(weight) + F.col("n")
        rate = a / total
        sd = F.sqrt(rate * (1 - rate) / (total + 1))
        out = out.withColumn(f"rate_{k}", rate)
        rejected = rejected | (rate - sds * sd > max_rate)
    return out.withColumn("host_rejected", rejected)


def _rejected(verdicts: DataFrame) -> DataFrame:
    """Rejected hosts, broadcast only when they are counted and few."""
    hosts = stored(verdicts.filter("host_rejected").select("source", F.lit(True).alias("host_rejected")))
    return F.broadcast(hosts) if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else hosts


def quality_rules(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, text): text figures, base rule and verdict.

    A null or wordless text has figures of 0 and fails; a null source has no
    host verdict; repeated rows are judged and counted one by one; other
    columns are ignored; an empty table gives an empty result.
    """
    stats = stored(with_stats(docs, ["doc_id", "source"]))
    hosts = _rejected(host_verdicts(stats, max_rate))
    joined = stats.join(hosts, "source", "left")
    failed = base_failed()
    return joined.select(
        "doc_id",
        *STATS,
        failed.alias("base_failed"),
        (~failed & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
        F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
        "source",
    )


def keep_good(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that pass, with their columns; texts are not shuffled, only hosts are joined.

    A null or wordless text goes; a null source has no host verdict; repeated
    rows stay or go together; columns of any name stay as they are; an empty
    table stays empty.
    """
    hosts = _rejected(host_verdicts(with_stats(docs, ["source"]), max_rate))

    def sound(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = (text_stats(t) for t in batch.column("text").to_pylist())
        return batch.filter(pa.array([n >= 50 and 100 * r <= 50 * n for n, _, _, _, r in found], pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return per_batch(docs, sound, fields).join(hosts, "source", "left_anti").select(*docs.columns)
