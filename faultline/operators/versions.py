"""Raw report rows to the latest version of every report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_year_date, parse_month_year
from ..functions.text import trim_or_null

PLACEHOLDER = "No New or Updated Incident Reports"
COUNTRY = "US"
#: Raw columns that fields of a report are made of; all other fields come from those of KEPT.
READS = {
    "same_incident_id": ("same_incident_id",),
    "reporting_entity": ("reporting_entity",),
    "developer_or_operator": ("operating_entity", "reporting_entity"),
    "incident_date": ("incident_date",),
    "incident_date_precision": ("incident_date",),
    "malformed_incident_date": ("incident_date",),
    "report_submission_date": ("submission_date",),
    "malformed_submission_date": ("submission_date",),
    "city": ("city",),
    "state": ("state",),
    "automation_engagement_text": ("engagement_status",),
    "crash_interaction_counterpart_text": ("crash_with",),
    "subject_vehicle_precrash_movement_text": ("sv_movement",),
    "other_actor_precrash_movement_text": ("cp_movement",),
    "injury_outcome_text": ("injury",),
    "narrative": ("narrative",),
}
KEPT = ("generation", "report_id", "version", "src_ord")


def split_placeholders(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that report something, and administrative rows that say there is nothing new."""
    admin = F.col("report_type").eqNullSafe(PLACEHOLDER)
    return raw.filter(~admin), raw.filter(admin)


def placeholder_counts(raw: DataFrame) -> DataFrame:
    """Administrative rows by generation; any in ``current`` is an anomaly."""
    n = F.count_if(F.col("report_type").eqNullSafe(PLACEHOLDER))
    return raw.groupBy("generation").agg(n.alias("excluded")).withColumn(
        "anomaly", (F.col("generation") == "current") & (F.col("excluded") > 0)
    )


def split_malformed_versions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a version of digits, trimmed and with numeric ``version``; and the rest as they came.

    A version that no long holds (above 18 digits, zeros in front apart) is
    malformed, so it shows up among the rest and never loses in silence.
    """
    report, text = trim_or_null(F.col("report_id")), trim_or_null(F.col("report_version"))
    good = F.coalesce(report.isNotNull() & F.regexp_like(text, F.lit("^0*[0-9]{1,18}$")), F.lit(False))
    kept = raw.filter(good).withColumn("report_id", report).withColumn("version", text.try_cast("long"))
    return kept, raw.filter(~good)


def latest_version(df: DataFrame, key: tuple[str, ...] = ("generation", "report_id"), version: str = "version", order: str = "src_ord") -> DataFrame:
    """The row of the highest version of each key; the first row wins a tie. ``first_ord`` is where the key came first.

    ``order`` may be any type that has an order, a struct of file and row too.
    One aggregate with a partial step before the shuffle, so a key with
    many versions sends one row from each task.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(version), F.col(order)))
    return (
        df.groupBy(*reversed(key))  # rows are sorted by the first bytes of the first column, and ids differ early
        .agg(best.alias("best"), F.min(order).alias("first_ord"))
        .select(*key, *(F.col(f"best.`{c}`").alias(c) for c in rest), "first_ord")
    )


def raw_columns(rows: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns that reports are made of, or those that the named fields are: what is ranked is shuffled."""
    read = {*KEPT, *(c for f in fields or READS for c in READS.get(f, ()))}
    return rows.select(*(c for c in rows.columns if c in read))


def map_report(df: DataFrame, retrieved_on: str = "2026-09-06", fields: tuple[str, ...] = ()) -> DataFrame:
    """Latest rows as reports: trimmed text, parsed dates, engagement text of the current generation only.

    All fields, or those named; ``first_ord`` is always there.
    """
    t = lambda c: trim_or_null(F.col(c))
    asked = {c for f in fields or READS for c in READS.get(f, ())}
    dated = [x for x in ("incident_date", "submission_date") if x in df.columns and x in asked]
    df = df.withColumns({f"_{x}": month_year_date(F.col(x)) for x in dated})
    none = {"date": F.lit(None).cast("date"), "precision": F.lit("unknown"), "malformed": F.lit(False)}
    incident, submission = (parse_month_year(F.col(x), F.col(f"_{x}")) if x in dated else none for x in ("incident_date", "submission_date"))
    made = {
        "reporting_generation": F.col("generation"),
        "report_id": t("report_id"),
        "report_version": F.col("version"),
        "same_incident_id": t("same_incident_id"),
        "reporting_entity": t("reporting_entity"),
        "developer_or_operator": F.coalesce(t("operating_entity"), t("reporting_entity")),
        "incident_date": incident["date"],
        "incident_date_precision": incident["precision"],
        "malformed_incident_date": incident["malformed"],
        "report_submission_date": submission["date"],
        "malformed_submission_date": submission["malformed"],
        "city": t("city"),
        "state": t("state"),
        "country_code": F.lit(COUNTRY),
        "automation_engagement_text": F.when(F.col("generation") == "current", t("engagement_status")),
        "crash_interaction_counterpart_text": t("crash_with"),
        "subject_vehicle_precrash_movement_text": t("sv_movement"),
        "other_actor_precrash_movement_text": t("cp_movement"),
        "injury_outcome_text": t("injury"),
        "narrative": t("narrative"),
        "retrieved_on": F.lit(retrieved_on).cast("date"),
    }
    return df.select(*(c.alias(name) for name, c in made.items() if not fields or name in fields), "first_ord")


def report_anomalies(reports: DataFrame) -> DataFrame:
    """(reporting_generation, report_id, anomaly) for malformed dates and a blank reporting entity."""
    found = F.array(
        F.when(F.col("malformed_incident_date"), F.lit("malformed-incident-date")),
        F.when(F.col("malformed_submission_date"), F.lit("malformed-submission-date")),
        F.when(F.col("reporting_entity").isNull(), F.lit("blank-reporting-entity")),
    )
    return reports.select(
        "reporting_generation", "report_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("anomaly")
    )


def generation_stats(raw: DataFrame) -> DataFrame:
    """Counts for each generation: rows, administrative rows, malformed versions, reports, reports and ids of incidents."""
    counted = raw.groupBy("generation").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(F.col("report_type").eqNullSafe(PLACEHOLDER)).alias("excluded"),
    )
    kept, malformed = split_malformed_versions(split_placeholders(raw)[0])
    bad = malformed.groupBy("generation").agg(F.count(F.lit(1)).alias("malformed"))
    latest = latest_version(kept)
    incident = trim_or_null(F.col("same_incident_id"))
    reports = latest.groupBy("generation").agg(
        F.count(F.lit(1)).alias("latest"),
        F.count_if(incident.isNull()).alias("blank_incident_ids"),
        F.count_distinct(incident).alias("distinct_incident_ids"),
    )
    out = counted.join(bad, "generation", "left").join(reports, "generation", "left")
    return out.na.fill(0, ["malformed", "latest", "blank_incident_ids", "distinct_incident_ids"])
