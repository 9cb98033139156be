"""Canonical names: dictionary, canonicalisation, facets and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical names with the raw spellings that stand for them; a name alone stands for itself.
NAMES: dict[str, tuple[str, ...]] = {
    "Waymo": ("Waymo", "Waymo LLC", "WAYMO LLC", "Waymo LLc", "Waymo LLlC"),
    "Tesla": ("Tesla", "Tesla Inc"),
    "Cruise": ("Cruise", "CRUISE", "Cruise LLC"),
    "Zoox": ("Zoox", "Zoox Inc.", "Zoox, Inc"),
    "Avride": ("Avride", "Avride Inc", "Avride INC", "Avride Inc.", "Avride INC."),
    "Aurora": ("Aurora Operations, Inc", "Aurora Operations, Inc."),
    "May Mobility": ("May Mobility", "May Mobility Inc", "May Mobility Inc."),
    "Nuro": ("Nuro", "Nuro Inc", "Nuro Inc.", "Nuro, Inc."),
    "Beep": ("Beep", "BEEP Inc", "Beep Inc.", "Beep, Inc", "Beep, Inc."),
    "Kodiak Robotics": ("Kodiak Robotics, Inc", "Kodiak Robotics, Inc."),
    "Pony.ai": ("Pony.ai", "Pony.ai, Inc", "Pony.ai, Inc."),
    "PlusAI": ("PLUSAI, INC", "PlusAI, Inc."),
    "Torc Robotics": ("Torc Robotics, Inc", "TORC ROBOTICS, INC"),
    "WeRide": ("WeRide", "Weride Corp", "WeRide Corp"),
    "ADMT / VWGoA": ("ADMT - VWGoA", "ADMT- VWGoA", "VWGoA- ADMT"),
    "Mercedes-Benz R&D North America": (
        "Mercedes-Benz RD NA",
        "Mercedes-Benz Research and Development NA",
        "Mercedes-Benz Research and Development North America",
    ),
    "Apollo Autonomous Driving USA": ("Apollo Autonomous Driving USA",),
    "Apple": ("Apple Inc.",),
    "Argo AI": ("Argo AI",),
    "AutoX Technologies": ("AutoX Technologies, Inc.",),
    "Chrysler": ("Chrysler (FCA US, LLC)",),
    "Colorado School of Mines": ("Colorado School of Mines",),
    "First Transit": ("First Transit, Inc.",),
    "Gatik AI": ("Gatik AI Inc.",),
    "Ghost Autonomy": ("Ghost Autonomy Inc.",),
    "Hyundai Motor America": ("Hyundai Motor America",),
    "Kia America": ("Kia America, Inc.",),
    "Lucid": ("Lucid USA, Inc.",),
    "Motional": ("Motional",),
    "Navistar": ("Navistar, Inc.",),
    "NAVYA": ("NAVYA Inc.",),
    "Ohmio": ("Ohmio",),
    "Polestar": ("Polestar",),
    "Robotic Research": ("Robotic Research",),
    "Stack AV": ("Stack AV Co.",),
    "TuSimple": ("TuSimple",),
    "VinFast": ("VinFast Auto, LLC",),
    "VisLab": ("VisLab, SRL (subsidiary of Ambarella, Inc.)",),
    "Zoox and Waymo": ("Zoox and Waymo",),
}
EXCLUDED = ("Internal employee",)


def names(spark: SparkSession, groups: dict[str, tuple[str, ...]] = NAMES) -> DataFrame:
    """(raw, canonical) rows of a dictionary."""
    return spark.createDataFrame([(r, c) for c, raws in groups.items() for r in raws], "raw string, canonical string")


def canonicalise(events: DataFrame, dictionary: DataFrame, column: str = "developer_or_operator") -> DataFrame:
    """Adds ``canonical``: the dictionary's name, or the value as it is. Spark broadcasts a small dictionary by its size."""
    known = dictionary.select(F.col("raw").alias(column), "canonical")
    return events.join(known, column, "left").withColumn("canonical", F.coalesce("canonical", column))


def filter_events(
    events: DataFrame, dictionary: DataFrame, event_type: str | None = None, valence: str | None = None, name: str | None = None
) -> DataFrame:
    """Events that match all facets that are given; a raw name stands for its canonical one."""
    out = events
    if event_type is not None:
        out = out.filter(F.col("event_type") == event_type)
    if valence is not None:
        out = out.filter(F.col("valence") == valence)
    if name is None:
        return out
    wanted = canonicalise(events.sparkSession.createDataFrame([(name,)], "n string"), dictionary, "n")
    return canonicalise(out, dictionary).join(wanted.select("canonical"), "canonical", "left_semi").select(*events.columns)


def filter_raw_in(events: DataFrame, dictionary: DataFrame, canonical: str) -> DataFrame:
    """Events whose raw name stands for ``canonical``; a canonical name that is not known stands for itself."""
    raws = dictionary.filter(F.col("canonical") == canonical).select("raw", "canonical")
    itself = events.sparkSession.createDataFrame([(canonical, canonical)], "raw string, canonical string")
    names = raws.unionByName(itself.join(raws, "canonical", "left_anti").select("raw", "canonical"))
    return events.join(names.select(F.col("raw").alias("developer_or_operator")), "developer_or_operator", "left_semi")


def facet_options(events: DataFrame, dictionary: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Distinct canonical names without the excluded raw ones, in locale order."""
    named = events.filter(F.col("developer_or_operator").isNotNull() & ~F.col("developer_or_operator").isin(*excluded))
    out = canonicalise(named.select("developer_or_operator").distinct(), dictionary).select("canonical").distinct()
    return out.orderBy(F.collate("canonical", "UNICODE"), "canonical")


def canonical_counts(events: DataFrame, dictionary: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Events by canonical name, most first; excluded names count under a null name."""
    counted = events.groupBy("developer_or_operator").agg(F.count(F.lit(1)).alias("n"))
    named = canonicalise(counted, dictionary)
    name = F.when(~F.coalesce(F.col("developer_or_operator").isin(*excluded), F.lit(False)), F.col("canonical"))
    return named.groupBy(name.alias("canonical")).agg(F.sum("n").alias("events")).orderBy(F.desc("events"), "canonical")


def dictionary_coverage(dictionary: DataFrame, events: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(problem, raw): raw spellings in several groups, seen but in none, or in a group but not seen."""
    seen = events.select(F.col("developer_or_operator").alias("raw")).filter("raw is not null").distinct()
    several = dictionary.groupBy("raw").agg(F.count_distinct("canonical").alias("n")).filter("n > 1")
    missing = seen.filter(~F.col("raw").isin(*excluded)).join(dictionary, "raw", "left_anti")
    extra = dictionary.select("raw").distinct().join(seen, "raw", "left_anti")
    tag = lambda df, p: df.select(F.lit(p).alias("problem"), "raw")
    return tag(several, "several-groups").unionByName(tag(missing, "missing")).unionByName(tag(extra, "extra"))


def label_of(df: DataFrame, labels: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``label`` from a (value, label) dictionary, and the distinct values that it lacks."""
    out = df.join(labels.select(F.col("value").alias(column), "label"), column, "left")
    misses = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return out, misses.join(labels.select(F.col("value").alias(column)), column, "left_anti")
