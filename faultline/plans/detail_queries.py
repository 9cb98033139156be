"""Queries of steps that others contain: bases and sentences of labels, notes, dates, values of atoms, parts of merges; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import consolidate, evidence, geo, merge, quality
from ..operators import rules_data as R
from ..operators.classify import ACTIVE_MOVES
from ..sources import io
from . import fixtures, pipelines
from .fixtures import table
from .lifecycle_queries import d_sql, digit
from .oracles import CANDIDATES, CAUSES, CONFLICTS, CORPUS, CP, CUES, DRAFTS, FLAGGED, MAPPED, OM, OVER, PLACES, REPORTS, SM, SUPPORTED, TYPES, VALENCE, chain, w
from .oracles import text as quote
from .queries import LABELS, joined

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


CAUSE_BASES = ("not-struck", "multi-contact", "infrastructure", "infrastructure", "animal", "rear-end", "traffic-violation", "lane-intrusion", "occupant", "standing")
MANUAL = f"{SM} IN ({', '.join(map(quote, ACTIVE_MOVES))}) AND automation_status = 'driving-automation-not-engaged'"
HEDGED = "candidate_id IN (SELECT candidate_id FROM hedges WHERE topic IN ('mechanism', 'other') AND phrase IS NOT NULL)"
CAUSE = chain([*((c, b) for (c, _, _), b in zip(CAUSES, CAUSE_BASES)), (MANUAL, "manual-manoeuvre"), (HEDGED, "hedge")], "default")
TYPE = chain(
    [(c, b) for (c, _), b in zip([("not_struck", ""), ("infrastructure AND human_first", ""), *TYPES[1:], (f"{CP} = 'First Responder Vehicle'", "")],
                                 ("not-struck", "infrastructure-human", "infrastructure", "animal", "road-user", "emergency", "no-contact", "responder"))],
    "default",
)
WORTH = chain(
    [("not_struck", "not-struck"), ("infrastructure AND human_first", "infrastructure-human"), *((c, b) for (c, _), b in zip(VALENCE[1:], ("infrastructure", "animal", "handled")))],
    "default",
)


@query(
    w(DRAFTS, f"""SELECT candidate_id, CASE WHEN {MAPPED} IS NOT NULL THEN 'field' WHEN kinds = 1 THEN 'narrative' WHEN kinds > 1 THEN 'narratives-differ' ELSE 'none' END AS automation_status,
    CASE WHEN raw_cause = 'other-party-contributed' AND occupant_action THEN 'occupant-conflict' ELSE {CAUSE} END AS causation_status, {TYPE} AS event_type, {WORTH} AS valence FROM drafts""")
)
def c_bases(spark: SparkSession, sf: str) -> DataFrame:
    """The rule that gave each label of each candidate (C1 to C6)."""
    return fixtures.drafts(spark, sf).select("candidate_id", *(F.col(f"{x}.basis").alias(x) for x in LABELS))


@query(w(DRAFTS, f"SELECT candidate_id, {SUPPORTED} AS supported FROM drafts"))
def c3_contribution(spark: SparkSession, sf: str) -> DataFrame:
    """Whether automation may be said to have contributed."""
    from ..operators.classify import contribution_supported

    return fixtures.drafts(spark, sf).select("candidate_id", contribution_supported().alias("supported"))


NAMED_FIELD = "replace(CASE field WHEN 'injury_outcome' THEN 'injury_outcome_text' ELSE field END, '_', ' ')"
SHAPES = ", ".join(map(quote, R.SHAPE_FIELDS))


@query(
    w(FLAGGED, f"""{CONFLICTS},
    open AS (SELECT f.candidate_id, i, 'The reports give several values of ' || {NAMED_FIELD} || ': ' || array_to_string(vs, ' / ') || '; which one holds is for a curator to say.' AS said
      FROM folded f JOIN resolved r ON f.candidate_id = r.candidate_id WHERE NOT (field = 'developer_or_operator' AND developer_canonical IS NOT NULL) AND NOT (field = 'city' AND city_canonical IS NOT NULL)),
    shapes AS (SELECT candidate_id, 99 AS i, 'There is a source-record inconsistency: the reports of this incident differ in ' || count(*) || ' fields that shape the event (' || string_agg(field, ', ' ORDER BY i)
      || '). Which account holds, and whether it is one event, stays open.' AS said FROM folded WHERE field IN ({SHAPES}) GROUP BY candidate_id HAVING count(*) >= 2)
    SELECT candidate_id, string_agg(said, ' ' ORDER BY i) AS unknowns FROM (SELECT * FROM open UNION ALL SELECT * FROM shapes) GROUP BY candidate_id""".replace("\nconflict AS", ", conflict AS", 1))
)
def c8_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences for what reports leave open."""
    d = fixtures.drafts(spark, sf).select("candidate_id", "unknowns")
    return d.filter(F.size("unknowns") > 0).select("candidate_id", joined("unknowns", " ").alias("unknowns"))


@query(w(CANDIDATES, "SELECT candidate_id, curator_note FROM notes"))
def a5_curator_notes(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.candidates(spark, sf).select("candidate_id", "curator_note").filter("curator_note is not null")


@query(w(CANDIDATES, "SELECT candidate_id, strftime(incident_date, '%Y-%m-%d') AS incident_date, incident_date_precision, narrative FROM cand"))
def a3_dates_and_narratives(spark: SparkSession, sf: str) -> DataFrame:
    """The date that reports agree on and the narrative that stands for them, from values that merge (A3, A6)."""
    c = consolidate.consolidate(pipelines.latest_reports(fixtures.raw_reports(spark, sf)))
    return c.select("candidate_id", F.col("incident_date").cast("string").alias("incident_date"), "incident_date_precision", "narrative")


@query(
    w(CANDIDATES, "SELECT candidate_id, report_id, field, value FROM (" + " UNION ALL ".join(
        f"SELECT candidate_id, report_id, {quote(f)} AS field, "
        + {"incident_date": "strftime(incident_date, '%Y-%m-%d')", "incident_date_precision": "CASE WHEN incident_date IS NULL THEN 'unknown' ELSE 'month' END"}.get(f, f)
        + " AS value FROM ordered" for f in R.REPORT_FIELDS) + ") WHERE value IS NOT NULL")
)
def e15_atom_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values of all atoms that stand for a field of a report."""
    a = evidence.atoms(evidence.extract_evidence(fixtures.candidates(spark, sf)), only=R.REPORT_FIELDS)
    return a.select("candidate_id", "report_id", "field", "value")


MD5 = "CAST('0x' || substr(md5({}), 1, 1) AS INT)"


@query(
    w(CUES, f"SELECT candidate_id AS key, '9' AS rule, count(*) AS lost FROM hedges WHERE phrase IS NOT NULL AND {MD5.format('candidate_id')} < 4 GROUP BY candidate_id")
)
def v1_hedges_carried(spark: SparkSession, sf: str) -> DataFrame:
    """Rule 9: of a quarter of the candidates, the atoms of hedges were lost. Evidence is written once and read on both sides."""
    e = io.stored(evidence.report_cues(pipelines.marked_candidates(fixtures.raw_reports(spark, sf))).select("candidate_id", "hedge_list"))
    first = F.conv(F.substring(F.md5("candidate_id"), 1, 1), 16, 10).cast("int")
    kept = evidence.atoms(e, only=("narrative_hedge",)).filter(first >= 4)
    return quality.hedges_carried(e, kept).groupBy("key", "rule").agg(F.count(F.lit(1)).alias("lost"))


NATIONS = """n AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'country' WHEN 1 THEN 'region' WHEN 2 THEN 'city' ELSE 'street' END AS level,
  CASE WHEN n_nationkey % 3 <> 0 THEN 'R' END AS region_code, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS city_name,
  CAST(n_nationkey * 9 - 100 AS DOUBLE) AS latitude, CAST(n_nationkey * 18 - 200 AS DOUBLE) AS longitude, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_name END AS display_name FROM nation)"""


@query(
    f"""WITH {NATIONS} SELECT CAST(k AS VARCHAR) AS key, 'level-shape' AS rule FROM n WHERE NOT coalesce(level = 'country' AND region_code IS NULL AND city_name IS NULL
      OR level = 'region' AND region_code IS NOT NULL AND city_name IS NULL OR level = 'city' AND city_name IS NOT NULL, false)
    UNION ALL SELECT CAST(k AS VARCHAR), 'latitude' FROM n WHERE latitude NOT BETWEEN -90 AND 90 UNION ALL SELECT CAST(k AS VARCHAR), 'longitude' FROM n WHERE longitude NOT BETWEEN -180 AND 180
    UNION ALL SELECT CAST(k AS VARCHAR), 'display-name' FROM n WHERE trim(display_name) = ''"""
)
def v5_lookup_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as rows of a place table, with faults by their number."""
    n = spark.sql(f"WITH {NATIONS.replace('FROM nation)', 'FROM {nation})')} SELECT * FROM n", nation=table(spark, sf, "nation"))
    return quality.violations(n, "k", quality.lookup_constraints()).select("key", "rule")


@query(
    w(CANDIDATES, f"SELECT CASE WHEN same_incident_id IS NULL THEN 'singleton' ELSE 'grouped' END AS kind, CASE WHEN {MD5.format('candidate_id')} < 6 THEN 'reuse' ELSE 'insert' END AS action, count(*) AS n FROM cand GROUP BY ALL")
)
def j3_candidate_writes(spark: SparkSession, sf: str) -> DataFrame:
    """What an import would do to candidates of which three in eight are there."""
    c = fixtures.candidates(spark, sf).select("candidate_id", "same_incident_id")
    return merge.classify_candidate_writes(c, c.filter(F.conv(F.substring(F.md5("candidate_id"), 1, 1), 16, 10).cast("int") < 6))


@query(w(CORPUS, f"SELECT slug, is_public OR {d_sql('slug')} > 4 AS is_public FROM events"))
def m9_publish_sourced(spark: SparkSession, sf: str) -> DataFrame:
    """Events become public where a source is left; those of some slugs have lost theirs."""
    e, s = fixtures.corpus(spark, sf)
    return merge.publish_sourced(e, s.filter(digit("event_slug") > 4)).select("slug", "is_public")


@query(
    w(CORPUS, f""", {PLACES}, {OVER}, b AS (SELECT slug, origin = 'curated' AND p.level IS NOT NULL AS hit, p.level FROM events e LEFT JOIN (SELECT o.*, level FROM over o JOIN places ON key = lookup_key) p
      ON e.location_text IS NOT DISTINCT FROM p.location_text AND e.location_country_code IS NOT DISTINCT FROM p.location_country_code)
    SELECT slug, CASE WHEN hit AND {d_sql('slug')} % 2 = 1 THEN level ELSE 'unknown' END AS location_precision FROM b""".replace("\n, ", ", ", 1))
)
def m11_undo_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A backfill of all events, undone for half of those that it changed."""
    e = fixtures.events(spark, sf, "slug", "location_text", "location_country_code", "origin", keep=True).withColumn("location_precision", F.lit("unknown"))
    filled = merge.backfill_where_unknown(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark))
    changed = filled.filter("action = 'update'").filter(digit("slug") % 2 == 0).select("slug")
    return merge.undo_backfill(filled.drop("action"), changed).select("slug", "location_precision")


@query(w(REPORTS, "SELECT reporting_generation || ':' || report_id AS id, reporting_generation AS generation, report_id AS report FROM reports"))
def p13_external_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Record ids of all reports, and the parts that they split into."""
    r = pipelines.latest_reports(fixtures.raw_reports(spark, sf))
    key = text.external_record_id(F.col("reporting_generation"), F.col("report_id"))
    generation, report = text.split_external_id(F.col("id"))
    return r.select(key.alias("id")).select("id", generation.alias("generation"), report.alias("report"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_name || ', Inc. ' WHEN 1 THEN upper(p_name) || '-Co' WHEN 2 THEN '  ' ELSE p_name END AS s FROM part)
    SELECT p_partkey, nullif(trim(s), '') AS trimmed, trim(regexp_replace(regexp_replace(lower(s), '[-.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS name_key,
      trim(regexp_replace(regexp_replace(lower(s), '[.,]', '', 'g'), '\\s+', ' ', 'g')) AS text_key FROM p"""
)
def p21_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in several spellings: trimmed or null, and the keys under which they are one (P1, P21)."""
    k, n = F.col("p_partkey"), F.col("p_name")
    s = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), n, F.lit(", Inc. ")))
        .when(k % 4 == 1, F.concat(F.upper(n), F.lit("-Co")))
        .when(k % 4 == 2, F.lit("  "))
        .otherwise(n)
    )
    p = table(spark, sf, "part").select("p_partkey", s.alias("s"))
    return p.select("p_partkey", text.trim_or_null(F.col("s")).alias("trimmed"), text.fold_name(F.col("s")).alias("name_key"), text.fold_text(F.col("s")).alias("text_key"))


@query("""SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[.!?][ \\t\\n\\x0B\\f\\r]+')) + 1)::BIGINT AS sentences FROM documents""")
def p25_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """How many sentences every document has."""
    return table(spark, sf, "documents").select("doc_id", F.size(text.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("sentences"))


@query(
    w(REPORTS, """SELECT raw_date AS said, CASE WHEN incident_date IS NULL THEN 'unknown' ELSE 'month' END AS precision, strftime(incident_date, '%Y-%m-%d') AS date, count(*) AS reports FROM reports GROUP BY ALL""")
)
def p2_month_years(spark: SparkSession, sf: str) -> DataFrame:
    """Every date text of the latest reports and what it is read as."""
    raw = fixtures.raw_reports(spark, sf)
    from ..operators import versions

    latest = versions.latest_version(versions.split_malformed_versions(versions.split_placeholders(raw)[0])[0])
    said = F.trim("incident_date")
    parsed = dates.parse_month_year(F.col("incident_date"))
    rows = latest.select(said.alias("said"), parsed["precision"].alias("precision"), parsed["date"].cast("string").alias("date"))
    return rows.groupBy("said", "precision", "date").agg(F.count(F.lit(1)).alias("reports"))
