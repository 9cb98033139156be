"""Classified candidates to catalogue events and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import format_partial_date
from ..functions.text import event_slug, external_record_id, location_text

# Date and publisher of the batch.
BATCH_DATE = "2026-09-06"
PUBLISHER_LABEL = "NHTSA SGO report "
# Labels of event types.
EVENT_TYPE_LABELS = {
    "collision": "Collision",
    "near-miss-or-safety-critical": "Near miss / safety-critical interaction",
    "unexpected-or-inappropriate-behaviour": "Unexpected or inappropriate behaviour",
    "unnecessary-stop-braking-or-hesitation": "Unnecessary stop / braking / hesitation",
    "traffic-rule-or-infrastructure-interpretation": "Traffic-rule or infrastructure interpretation",
    "vulnerable-road-user-interaction": "Pedestrian / cyclist / vulnerable-road-user interaction",
    "emergency-vehicle-interaction": "Emergency-vehicle interaction",
    "traffic-disruption-or-obstruction": "Traffic disruption / obstruction",
    "successful-challenging-interaction": "Successful challenging interaction",
    "other": "Other",
}


def to_event(classified: DataFrame, batch_date: str = BATCH_DATE) -> DataFrame:
    """One private event for each candidate; what no source gives stays null or empty."""
    none = lambda t: F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    return classified.select(
        "candidate_id",
        event_slug(F.col("candidate_id")).alias("slug"),
        none("string").alias("title"),
        none("string").alias("summary"),
        F.col("incident_date").alias("occurred_on"),
        F.col("incident_date_precision").alias("occurred_on_precision"),
        location_text(F.coalesce("city_canonical", "city"), F.col("state"), F.col("country_code")).alias("location_text"),
        F.col("country_code").alias("location_country_code"),
        "location_precision",
        F.coalesce("developer_canonical", "developer_or_operator").alias("developer_or_operator"),
        none("string").alias("system_name"),
        F.col("automation_status.value").alias("automation_status"),
        none("string").alias("system_version"),
        F.lit("unknown").alias("system_version_knowledge"),
        F.col("event_type.value").alias("event_type"),
        F.col("valence.value").alias("valence"),
        empty.alias("observed_facts"),
        "unknowns",
        none("string").alias("interpretation"),
        F.col("causation_status.value").alias("causation_status"),
        F.col("causation_status.justification").alias("causation_note"),
        F.coalesce("scenario_tags.value", empty).alias("scenario_tags"),
        none("string").alias("review_status"),
        F.lit(batch_date).cast("date").alias("record_updated"),
        F.lit(False).alias("is_public"),
        F.lit("source-derived").alias("origin"),
    )


def source_of(r: Column) -> Column:
    """The source row of a report, as a struct."""
    return F.struct(
        F.lit(None).cast("string").alias("url"),
        F.lit("regulatory-record").alias("source_type"),
        external_record_id(r["reporting_generation"], r["report_id"]).alias("external_record_id"),
        r["reporting_entity"].alias("publisher"),
        F.concat(F.lit(PUBLISHER_LABEL), r["report_id"], F.lit(" (v"), r["report_version"].cast("string"), F.lit(")")).alias("label"),
        r["report_submission_date"].alias("published_on"),
        F.when(r["report_submission_date"].isNull(), "unknown").otherwise("month").alias("published_on_precision"),
        r["retrieved_on"].alias("retrieved_on"),
        F.lit(None).cast("string").alias("note"),
    )


def to_event_source(classified: DataFrame) -> DataFrame:
    """One row for each contributing report of each event, from the reports that travel with the candidate."""
    rows = classified.select(event_slug(F.col("candidate_id")).alias("event_slug"), F.explode(F.transform("reports", source_of)).alias("s"))
    return rows.select("event_slug", "s.*")


def event_title(developer: Column, event_type: Column, place: Column, date: Column, precision: Column) -> Column:
    """``developer label``, then place and date where known; null where developer or label is missing."""
    kind = None
    for value, text in EVENT_TYPE_LABELS.items():
        kind = F.when(event_type == value, text) if kind is None else kind.when(event_type == value, text)
    head = F.concat(F.nullif(developer, F.lit("")), F.lit(" "), kind)
    whole = F.concat_ws(" — ", head, F.nullif(place, F.lit("")), format_partial_date(date, precision, None))
    return F.when(head.isNotNull(), whole)


def titled(events: DataFrame) -> DataFrame:
    made = event_title(*(F.col(c) for c in ("developer_or_operator", "event_type", "location_text", "occurred_on", "occurred_on_precision")))
    return events.withColumn("title", made)
