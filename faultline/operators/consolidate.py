"""Reports of one incident to one candidate, with what the reports disagree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_key, matches, present

#: Candidate field and report field of what reports must agree on.
MIRRORED = {
    "developer_or_operator": "developer_or_operator",
    "city": "city",
    "state": "state",
    "automation_engagement": "automation_engagement_text",
    "crash_interaction_counterpart": "crash_interaction_counterpart_text",
    "subject_vehicle_precrash_movement": "subject_vehicle_precrash_movement_text",
    "other_actor_precrash_movement": "other_actor_precrash_movement_text",
    "injury_outcome": "injury_outcome_text",
}

# Words of an account of the event (+1 for each group), and phrases of filing (-2 each).
EVENT_WORDS = (
    r"\b(travel(l)?ing|proceeding|approach(ed|ing)?|stopped|parked|braked|brake|accelerat\w*|decelerat\w*)\b",
    r"\b(collision|collided|contact|struck|strike|rear-ended|swerv\w*|veer\w*)\b",
    r"\b(lane|intersection|roadway|crosswalk|shoulder|median)\b",
    r"\b(pedestrian|cyclist|vehicle|truck|driver|passenger)\b",
)
FILING_PHRASES = (
    r"filed (an|a) (incident )?report",
    r"standing general order",
    r"is submitting a duplicate",
    r"solely to avoid",
    r"incorporates?[^.]{0,60}by reference",
    r"based on facts supplied to",
    r"has not investigated the alleged incident",
    r"no independent knowledge of the facts",
    r"manufactured the[^.]{0,60}operated motor vehicle",
)


# How a note begins and ends.
NOTE_START, NOTE_END = "Import: contributing reports disagree on ", ". Left blank for curator review."


DISAGREEMENT = "struct<field:string,values:array<string>>"


def distinct_in_order(reports: Column, field: str) -> Column:
    """Distinct non-null values of a field, in the order of the reports."""
    return F.array_except(reports[field], F.array(F.lit(None).cast("string")))


def agreed(values: Column) -> Column:
    """The one value of an array of distinct values; null for none or several."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def narrative_score(text: Column) -> Column:
    hit = lambda p: matches(text, (p,)).cast("int")
    return sum((hit(p) for p in EVENT_WORDS), F.lit(0)) - 2 * sum((hit(p) for p in FILING_PHRASES), F.lit(0))


def representative_text(score: Column | None = None) -> Column:
    """An aggregate: the narrative that says most of the event by best score, then longest, then generation and report id.

    ``score`` is a column of scores that were given before; without it, narratives are scored here.
    """
    t = F.col("narrative")
    score = narrative_score(t) if score is None else score
    # Absent texts come last by a field of the rank: within a condition Spark would fold the case of a text for each pattern again.
    return F.min_by(t, F.struct(t.isNull(), -score, -F.length(t), F.col("reporting_generation"), F.col("report_id")))


def agreed_date(reports: Column) -> tuple[Column, Column]:
    """struct(date, precision) that known dates agree on, and the distinct pairs as text."""
    known = F.filter(reports, lambda r: r["incident_date_precision"] != "unknown")
    pairs = F.array_distinct(
        F.transform(known, lambda r: F.struct(r["incident_date"].alias("date"), r["incident_date_precision"].alias("precision")))
    )
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit("unknown").alias("precision"))
    texts = F.transform(pairs, lambda p: F.concat_ws("|", p["date"].cast("string"), p["precision"]))
    return F.when(F.size(pairs) == 1, F.get(pairs, F.lit(0))).otherwise(none), texts


def build_candidates(reports: DataFrame) -> DataFrame:
    """One candidate for each incident id over all generations, and one for each report without an id.

    One shuffle, on a key that is never null. The group's reports travel with
    the candidate as an array in input order, so evidence, classification and
    source rows need no join back; columns that are added to the reports
    before travel along. A candidate is its reports, so a group has to fit a
    row; ``group_size_stats`` shows the largest.

    Reports are shuffled as rows: few of an incident share a task before, and
    partial groups would hold each narrative twice, in the array and as the
    best so far. Narratives are scored before, and not at all where nobody
    asks for the text.
    """
    fields = [c for c in reports.columns if c != "first_ord"]
    rank = F.when(F.col("reporting_generation") == "historical", 0).otherwise(1)
    row = F.struct(rank.alias("rank"), F.col("first_ord").alias("first_ord"), *fields)
    key = identity_key(F.col("same_incident_id"), F.col("reporting_generation"), F.col("report_id"))
    keyed = reports.withColumns({"candidate_id": key, "_score": narrative_score(F.col("narrative"))}).repartition("candidate_id")
    grouped = keyed.groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(row)).alias("reports"),
        F.first("same_incident_id").alias("same_incident_id"),
        representative_text(F.col("_score")).alias("narrative"),
    )
    r = F.col("reports")
    wide = grouped.select("*", *(distinct_in_order(r, f).alias(f"_{c}") for c, f in MIRRORED.items()))
    date, dates = agreed_date(r)
    wide = wide.select("*", date.alias("_date"), dates.alias("_dates"))
    conflict = lambda name, values: (F.size(values) > 1, F.struct(F.lit(name).alias("field"), values.alias("values")))
    conflicts = present(DISAGREEMENT, *(conflict(MIRRORED[c], F.col(f"_{c}")) for c in MIRRORED), conflict("incident_date", F.col("_dates")))
    return wide.select(
        "candidate_id",
        "same_incident_id",
        *(agreed(F.col(f"_{c}")).alias(c) for c in MIRRORED),
        F.col("_date.date").alias("incident_date"),
        F.col("_date.precision").alias("incident_date_precision"),
        F.lit("US").alias("country_code"),
        "narrative",
        conflicts.alias("disagreements"),
        F.transform(
            r, lambda x: F.struct(x["reporting_generation"].alias("generation"), x["report_id"].alias("report_id"))
        ).alias("report_keys"),
        "reports",
        F.lit("pending").alias("status"),
    ).withColumn("curator_note", curator_note(F.col("disagreements")))


#: The order of reports as one long: historical ones first, then by where a report came first.
LATER = 1 << 61


def keyed_reports(reports: DataFrame) -> DataFrame:
    """Reports with ``candidate_id`` and ``place``, their order within an incident."""
    key = identity_key(F.col("same_incident_id"), F.col("reporting_generation"), F.col("report_id"))
    late = F.when(F.col("reporting_generation") == "historical", F.lit(0)).otherwise(F.lit(LATER))
    return reports.withColumns({"candidate_id": key, "place": late + F.col("first_ord")})


def stated_values(keyed: DataFrame) -> DataFrame:
    """(candidate_id, field, value, first): distinct values that an incident's reports state, and where each came first.

    The state of a value is one long, so tasks combine what they hold before
    the shuffle, and an incident is spread over its fields and values.
    ``field`` is a place in ``MIRRORED``; the number after them stands for the
    date with its precision.
    """
    date = F.when(
        F.col("incident_date_precision") != "unknown", F.concat_ws("|", F.col("incident_date").cast("string"), F.col("incident_date_precision"))
    )
    values = [F.col(f).cast("string") for f in MIRRORED.values()] + [date]
    each = F.array(*(F.struct(F.lit(i).alias("field"), v.alias("value")) for i, v in enumerate(values)))
    said = keyed.select("candidate_id", "place", F.explode(each).alias("s")).filter(F.col("s.value").isNotNull())
    return said.groupBy("candidate_id", F.col("s.field").alias("field"), F.col("s.value").alias("value")).agg(F.min("place").alias("first"))


def consolidate(reports: DataFrame) -> DataFrame:
    """Candidates without their reports: agreed fields, disagreements, representative narrative, note and number of reports.

    No step holds the reports of an incident: values are combined by (incident,
    field, value) in :func:`stated_values`, and only the distinct ones are
    gathered, in the order in which they came first; narratives are combined
    as the best one so far. An incident of any number of reports takes as much
    memory as it has distinct values. Reports stay rows: see :func:`members`.
    """
    keyed = keyed_reports(reports)
    told = stated_values(keyed).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("field", "first", "value"))).alias("said"))
    one = keyed.groupBy("candidate_id").agg(
        F.min("same_incident_id").alias("same_incident_id"), representative_text().alias("narrative"), F.count(F.lit(1)).alias("n_reports")
    )
    wide = one.join(told, "candidate_id", "left")
    n = len(MIRRORED)
    values = lambda i: F.transform(F.filter("said", lambda s: s["field"] == i), lambda s: s["value"])
    wide = wide.select("*", *(values(i).alias(f"_{i}") for i in range(n + 1)))
    lone = lambda i: F.when(F.size(F.col(f"_{i}")) == 1, F.get(F.col(f"_{i}"), F.lit(0)))
    wide = wide.withColumn("_date", lone(n))
    names = [*MIRRORED.values(), "incident_date"]
    conflict = lambda name, values: (F.size(values) > 1, F.struct(F.lit(name).alias("field"), values.alias("values")))
    conflicts = present(DISAGREEMENT, *(conflict(name, F.col(f"_{i}")) for i, name in enumerate(names)))
    return wide.select(
        "candidate_id",
        "same_incident_id",
        *(lone(i).alias(c) for i, c in enumerate(MIRRORED)),
        F.split_part("_date", F.lit("|"), F.lit(1)).cast("date").alias("incident_date"),
        F.coalesce(F.split_part("_date", F.lit("|"), F.lit(2)), F.lit("unknown")).alias("incident_date_precision"),
        F.lit("US").alias("country_code"),
        "narrative",
        conflicts.alias("disagreements"),
        "n_reports",
        F.lit("pending").alias("status"),
    ).withColumn("curator_note", curator_note(F.col("disagreements")))


def members(reports: DataFrame) -> DataFrame:
    """Reports as rows of their candidates: candidate_id, place (their order in it) and all columns."""
    return keyed_reports(reports)


def curator_note(disagreements: Column) -> Column:
    parts = F.transform(disagreements, lambda d: F.concat(d["field"], F.lit(" ("), F.array_join(d["values"], " / "), F.lit(")")))
    return F.when(
        F.size(disagreements) > 0,
        F.concat(
            F.lit(NOTE_START),
            F.array_join(parts, "; "),
            F.lit(NOTE_END),
        ),
    )


def disagreements(candidates: DataFrame) -> DataFrame:
    """Long table (candidate_id, field, values)."""
    return candidates.select("candidate_id", F.explode("disagreements").alias("d")).select("candidate_id", "d.field", "d.values")


def disagreement_histogram(candidates: DataFrame) -> DataFrame:
    """Candidates with a disagreement on each field."""
    return disagreements(candidates).groupBy("field").agg(F.count(F.lit(1)).alias("candidates"))


def group_size_stats(candidates: DataFrame) -> DataFrame:
    """Candidates, those of several reports, the largest group, and groups that name several reporting entities."""
    size = F.size("reports")
    entities = F.size(distinct_in_order(F.col("reports"), "reporting_entity"))
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(size > 1).alias("multi_report"),
        F.max(size).cast("long").alias("largest"),
        F.count_if(entities > 1).alias("cross_entity"),
        F.count_if(F.col("same_incident_id").isNull()).alias("singletons"),
    )


def cross_entity_groups(candidates: DataFrame) -> DataFrame:
    """(candidate_id, same_incident_id, entities): candidates whose reports come from several reporting entities."""
    entities = distinct_in_order(F.col("reports"), "reporting_entity")
    return candidates.select("candidate_id", "same_incident_id", entities.alias("entities")).filter(F.size("entities") > 1)


def reports_of(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """Contributing reports of candidates that carry only keys: candidate_id, ord, and the report's columns."""
    keys = candidates.select("candidate_id", F.posexplode("report_keys").alias("ord", "k"))
    keys = keys.select(
        "candidate_id", "ord", F.col("k.generation").alias("reporting_generation"), F.col("k.report_id").alias("report_id")
    )
    return keys.join(reports, ["reporting_generation", "report_id"])
