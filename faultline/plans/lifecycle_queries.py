"""Queries over promotion, publication, imports and whole-corpus checks, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, dictionary, digest, evidence, merge, quality
from ..operators import rules_data as R
from ..operators.consolidate import MIRRORED
from ..sources import io
from . import fixtures, pipelines
from .fixtures import table
from .oracles import CORPUS, DRAFTS, T, any_of, quoted, text, w

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AT = "2026-09-10 00:00:00"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def digit(column: str, at: int = 8) -> Column:
    """One hexadecimal digit of a slug as a number: faults and batches are dealt by it."""
    return F.conv(F.substring(column, at, 1), 16, 10).cast("int")


def d_sql(column: str, at: int = 8) -> str:
    return f"CAST('0x' || substr({column}, {at}, 1) AS INT)"


def private(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The corpus before anything of it is public."""
    e, s = fixtures.corpus(spark, sf)
    return e.withColumns({"is_public": F.lit(False), "title": F.lit(None).cast("string"), "origin": F.lit("source-derived")}), s


def links(e: DataFrame, linked: Column) -> DataFrame:
    return e.select("candidate_id", F.when(linked, F.col("slug")).alias("linked_event_id"))


@query(w(CORPUS, "SELECT slug, candidate_id, (SELECT count(*) FROM sources WHERE event_slug = slug) AS n_sources FROM events"))
def m4_promote(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the events are there, whole and linked; promotion adds the others with their sources and links."""
    e, s = private(spark, sf)
    have, have_s = e.filter(digit("slug") >= 8), s.filter(digit("event_slug") >= 8)
    c, after, sources = merge.promote(links(e, digit("slug") >= 8), have, have_s, e, s)
    linked = c.select(F.col("linked_event_id").alias("slug"), "candidate_id")
    n = catalogue.source_count(after.select("slug"), sources)
    return n.join(linked, "slug").select("slug", "candidate_id", F.col("source_count").alias("n_sources"))


@query(w(CORPUS, f"SELECT slug, CASE WHEN {d_sql('slug')} IN (0, 9) THEN 'C' WHEN {d_sql('slug')} >= 8 THEN 'A' ELSE 'B' END AS state FROM events"))
def m4_promotion_states(spark: SparkSession, sf: str) -> DataFrame:
    """Records of which some are linked without an event and some lack their sources."""
    e, s = private(spark, sf)
    k, ks = digit("slug"), digit("event_slug")
    n = s.groupBy(F.col("event_slug").alias("slug")).agg(F.count(F.lit(1)).alias("expected_sources"))
    records = e.select("candidate_id", "slug").join(n, "slug")
    c = links(e, (k >= 8) | (k == 0))
    return merge.promotion_states(c, e.filter(k >= 8), s.filter((ks >= 8) & (ks != 9)), records).select("slug", "state")


@query(
    w(CORPUS, f""", e AS (SELECT {d_sql('slug')} AS d FROM events), s AS (SELECT {d_sql('event_slug')} AS d FROM sources)
    SELECT 'link-without-event' AS problem, count(*) FILTER (d = 0) AS n FROM e UNION ALL SELECT 'event-without-link', count(*) FILTER (d = 12) FROM e
    UNION ALL SELECT 'event-linked-twice', count(*) FILTER (d = 13) FROM e UNION ALL SELECT 'event-without-source', count(*) FILTER (d = 9) FROM e
    UNION ALL SELECT 'source-without-event', count(*) FILTER (d = 1) FROM s UNION ALL SELECT 'duplicate-slug', count(*) FILTER (d = 14) FROM e
    UNION ALL SELECT 'public', count(*) FILTER (d = 10) FROM e UNION ALL SELECT 'titled', count(*) FILTER (d = 11) FROM e""").replace("\n, e AS", ", e AS")
)
def m5_promotion_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Each of the eight things that must not hold, put in by a digit of the slug."""
    e, s = private(spark, sf)
    k, ks = digit("slug"), digit("event_slug")
    c = links(e, ((k >= 8) & (k != 12)) | (k == 0))
    c = c.unionByName(links(e.filter(k == 13), F.lit(True)).withColumn("candidate_id", F.concat("candidate_id", F.lit(":again"))))
    have = e.filter(k >= 8).withColumns({"is_public": k == 10, "title": F.when(k == 11, F.lit("t"))})
    have = have.unionByName(have.filter(k == 14))
    return merge.promotion_problems(c, have, s.filter((ks >= 8) & (ks != 9) | (ks == 1)))


@query(
    w(CORPUS, f"SELECT slug, CASE WHEN {d_sql('slug')} < 8 THEN 'source-derived' ELSE origin END AS origin, CASE WHEN {d_sql('slug')} < 8 AND origin <> 'source-derived' THEN 'update' ELSE 'noop' END AS action, CASE WHEN {d_sql('slug')} < 8 THEN 'curated' ELSE origin END AS undone FROM events")
)
def m6_set_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Linked events get their origin, and lose it again."""
    e = fixtures.events(spark, sf, "slug", "candidate_id", "origin", keep=True)
    c = links(e, digit("slug") < 8)
    out = merge.set_origin(e, c)
    undone = merge.set_origin(out.drop("action"), c, undo="curated").select("slug", F.col("origin").alias("undone"))
    return out.select("slug", "origin", "action").join(undone, "slug")


@query(
    w(CORPUS, f"SELECT slug, CASE WHEN {d_sql('slug')} >= 4 THEN title END AS title, is_public AND {d_sql('slug')} >= 4 AS is_public, is_public AS stamped, CASE WHEN is_public AND {d_sql('slug')} < 4 THEN 'update' ELSE 'noop' END AS action FROM events")
)
def m8_unpublish(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the slugs become private; the time of first publication stays."""
    e, s = fixtures.corpus(spark, sf, keep=False)
    e = merge.stamp_first_published(e, AT)
    slugs = s.select(F.col("event_slug").alias("slug")).distinct().filter(digit("slug") < 4)
    out = merge.unpublish(e, slugs)
    return out.select("slug", "title", "is_public", F.col("first_published_at").isNotNull().alias("stamped"), "action")


@query(w(CORPUS, f"SELECT slug, CASE WHEN {d_sql('slug')} = 5 THEN '2025-01-01' WHEN is_public THEN '2026-09-10' END AS stamped FROM events"))
def m12_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """Public events are stamped once; a stamp from before stays."""
    old = F.when(digit("slug") == 5, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    e = merge.stamp_first_published(fixtures.events(spark, sf, "slug", "is_public").withColumn("first_published_at", old), AT)
    return e.select("slug", F.date_format("first_published_at", "yyyy-MM-dd").alias("stamped"))


# A manifest of pages, with faults dealt by the page's number.
MANIFEST = """
SELECT page_id AS k, 'L' || CAST(page_id AS STRING) AS legacy_id,
  CASE WHEN page_id % 23 = 0 THEN 'maybe' WHEN page_id % 4 = 0 THEN 'import' WHEN page_id % 4 = 1 THEN 'rejected' WHEN page_id % 4 = 2 THEN 'deferred' ELSE 'manual-review' END AS decision,
  CASE WHEN page_id % 11 = 0 THEN ' ' ELSE 'a reason' END AS decision_reason, 'Page ' || CAST(page_id AS STRING) AS legacy_title,
  CASE WHEN page_id % 13 = 0 THEN 'ftp://v.example/1' ELSE 'https://v.example/1' END AS source_url,
  CASE WHEN page_id % 17 = 0 THEN 'hologram' ELSE 'video' END AS media_kind,
  (page_id % 2 = 0 OR page_id % 10 = 9) AND page_id % 19 <> 0 AS is_event_video,
  CASE WHEN page_id % 31 = 1 THEN 'm' || CAST(page_id - 1 AS STRING) ELSE 'm' || CAST(page_id AS STRING) END AS media_id,
  CASE WHEN page_id % 4 = 0 AND page_id % 37 <> 0 OR page_id % 71 = 0 THEN 'curator-reviewed' ELSE 'unreviewed' END AS review_status,
  CASE WHEN page_id % 41 = 0 THEN 'crash' ELSE 'collision' END AS event_type, 'neutral-or-unclear' AS valence,
  CASE WHEN page_id % 3 = 0 THEN 'driving-automation-engaged-confirmed' ELSE 'unknown' END AS automation_status, 'undetermined' AS causation_status,
  CASE WHEN page_id % 5 = 0 THEN 'reported' ELSE 'first-hand' END AS collection,
  CASE WHEN page_id % 43 = 0 THEN 'day' ELSE 'unknown' END AS event_date_precision,
  CASE WHEN page_id % 47 = 0 THEN 'usa' ELSE 'US' END AS location_country_code,
  page_id % 53 = 0 AS bare, CASE WHEN page_id % 59 = 0 THEN ' ' ELSE 'Review of page ' || CAST(page_id AS STRING) END AS proposed_title,
  CASE WHEN page_id % 6 = 0 THEN 'exact-duplicate' ELSE 'unique' END AS duplicate_status,
  CASE WHEN page_id % 67 = 0 THEN NULL WHEN page_id % 12 = 0 THEN 'L' || CAST(page_id + 1 AS STRING) WHEN page_id % 6 = 0 THEN 's-' || CAST(page_id AS STRING) WHEN page_id % 61 = 0 THEN 'x' END AS duplicate_of
FROM pages
"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(MANIFEST.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf, "pages"))
    evidence = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(F.array(F.lit("seen")))
    return rows.withColumns(
        {
            "sources": F.array(F.struct("source_url", "media_kind", "is_event_video", "media_id")),
            "observable_evidence": evidence,
            "unknowns": F.array(F.lit("who")),
            "summary": F.lit("A summary."),
            "event_date": F.lit(None).cast("date"),
        }
    )


IMPORTS = "decision = 'import'"
MANIFEST_RULES = {
    "decision": "decision = 'maybe'",
    "decision-reason": "decision_reason = ' '",
    "event-video": f"{IMPORTS} AND NOT (is_event_video AND media_kind = 'video')",
    "review": f"{IMPORTS} AND review_status <> 'curator-reviewed'",
    "enum:event_type": f"{IMPORTS} AND event_type = 'crash'",
    "confirmed": f"{IMPORTS} AND automation_status LIKE '%confirmed' AND collection <> 'first-hand'",
    "date-pair": f"{IMPORTS} AND event_date_precision = 'day'",
    "country": f"{IMPORTS} AND location_country_code = 'usa'",
    "empty:observable_evidence": f"{IMPORTS} AND bare",
    "blank:proposed_title": f"{IMPORTS} AND proposed_title = ' '",
    "source-url": "source_url LIKE 'ftp%'",
    "media-kind": "media_kind = 'hologram'",
    "import-only": f"NOT {IMPORTS} AND review_status = 'curator-reviewed'",
    "rejected-video": "decision = 'rejected' AND is_event_video",
    "unique-of": "duplicate_status = 'unique' AND duplicate_of IS NOT NULL",
    "duplicate-of": "duplicate_status <> 'unique' AND duplicate_of IS NULL",
    "duplicate-import": f"{IMPORTS} AND duplicate_status = 'exact-duplicate'",
    "unresolved-duplicate": "duplicate_status <> 'unique' AND duplicate_of NOT IN (SELECT legacy_id FROM r UNION ALL SELECT 's-' || page_id FROM pages WHERE page_id % 18 = 0)",
}


@query(
    f"WITH r AS ({MANIFEST}) "
    + " UNION ALL ".join(f"SELECT legacy_id AS key, '{k}' AS rule FROM r WHERE {c}" for k, c in MANIFEST_RULES.items())
    + " UNION ALL SELECT media_id, 'duplicate-media' FROM r GROUP BY media_id HAVING count(*) > 1"
)
def v4_manifest(spark: SparkSession, sf: str) -> DataFrame:
    existing = table(spark, sf, "pages").filter("page_id % 18 = 0").select(F.concat(F.lit("s-"), "page_id").alias("slug"))
    return quality.manifest_violations(manifest(spark, sf), existing).select("key", "rule")


@query(
    f"""WITH r AS ({MANIFEST}), i AS (SELECT *, CASE WHEN k % 40 = 0 THEN 'special-' || k WHEN k % 59 = 0 THEN '' ELSE 'review-of-page-' || k END AS raw FROM r WHERE {IMPORTS}),
    n AS (SELECT *, count(*) OVER (PARTITION BY raw) AS held FROM i)
    SELECT CASE WHEN k % 40 <> 0 AND held > 1 THEN raw || '-' || lower(legacy_id) ELSE raw END AS slug, legacy_id, CASE WHEN k % 8 <> 0 OR k % 59 = 0 AND k % 40 <> 0 THEN 'insert' WHEN k % 16 = 0 THEN 'update' ELSE 'noop' END AS action FROM n"""
)
def w7_curated_import(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of the manifest on top of those of an earlier run, of which half have another id by now."""
    m = manifest(spark, sf)
    k = F.col("k")
    own = F.when(k % 40 == 0, F.concat(F.lit("special-"), k)).otherwise(F.concat(F.lit("review-of-page-"), k))
    earlier = m.filter(f"{IMPORTS} and k % 8 = 0 and (k % 59 <> 0 or k % 40 = 0)")
    target = earlier.select(own.alias("slug"), F.when(k % 16 == 0, F.lit("old")).otherwise(F.col("legacy_id")).alias("legacy_id"))
    overrides = m.filter("k % 40 = 0").select("legacy_id", F.concat(F.lit("special-"), k).alias("slug"))
    none = target.limit(0).select("slug")
    return pipelines.curated_import(m, none, overrides, target)["events"].select("slug", "legacy_id", "action")


@query(
    """WITH a AS (SELECT o_orderstatus AS name, count(*) AS actual FROM orders GROUP BY 1),
    e AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS name, count(*) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS expected FROM orders GROUP BY o_orderstatus)
    SELECT coalesce(a.name, e.name) AS name, actual, expected FROM a FULL JOIN e ON a.name = e.name WHERE actual IS DISTINCT FROM expected"""
)
def v9_expected_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status against approved counts, of which one is off by one and one has another name."""
    status = F.col("o_orderstatus")
    n = table(spark, sf, "orders").groupBy(status.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    name = F.col("name")
    approved = n.select(F.when(name == "F", "X").otherwise(name).alias("name"), F.when(name == "P", F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return quality.count_differences(n, approved)


BATCH = f"""{CORPUS}, b AS (SELECT e.*, concat_ws(',', CASE WHEN {d_sql('slug')} = 1 OR developer_or_operator IS NULL THEN 'null:developer_or_operator' END, CASE WHEN {d_sql('slug')} = 0 THEN 'status' END) AS failures FROM events e)"""


def linked_export(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(linked export, events) of private events; some candidates are no longer pending, some events name no developer."""
    e, s = private(spark, sf)
    k = digit("slug")
    e = e.withColumn("developer_or_operator", F.when(k != 1, F.col("developer_or_operator")))
    c = e.select("candidate_id", F.when(k == 0, "approved").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("same_incident_id"), F.col("slug").alias("linked_event_id"))
    return io.export_linked(c, e, s), e


@query(w(BATCH, "SELECT candidate_id AS key, failures FROM b WHERE failures <> ''"))
def o6_exception_report(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.publication_preconditions(linked_export(spark, sf)[0])
    return pipelines.exception_report(found).select("key", F.array_join("failures", ",").alias("failures"))


@query(w(BATCH, "SELECT slug, CASE WHEN failures = '' THEN title END AS title, failures = '' AS is_public, CASE WHEN failures = '' THEN 'update' ELSE 'noop' END AS action, failures FROM b"))
def w6_publication_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible events are titled and published, the others reported with what they fail."""
    linked, e = linked_export(spark, sf)
    out = pipelines.publication_batch(linked, e, AT)
    failed = out["exceptions"].select(F.col("key").alias("candidate_id"), F.array_join("failures", ",").alias("failures"))
    rows = out["events"].join(failed, "candidate_id", "left")
    return rows.select("slug", "title", "is_public", "action", F.coalesce("failures", F.lit("")).alias("failures"))


def _atom_sql() -> str:
    kind = "CASE WHEN n_reports > 1 THEN 'consolidated' ELSE 'structured' END"
    parts = []

    def add(tier: str, field: str, source: str, where: str, frm: str = "drafts") -> None:
        parts.append(f"SELECT {text(tier)} AS tier, {text(field)} AS field, {source} AS source_type, candidate_id FROM {frm} WHERE {where}")

    for f in R.CANDIDATE_FIELDS:
        add("EVIDENCE", f"candidate.{f}", "'narrative'" if f == "narrative" else kind, f"{f} IS NOT NULL")
    for flag, field, _, tier, patterns in evidence.FLAGS:
        add(tier, field, "'narrative'" if patterns else "'rule'", flag)
    for field, where in (
        ("source_record_inconsistency", "inconsistent"),
        ("developer_or_operator_canonical", "developer_canonical IS NOT NULL"),
        ("city_canonical", "city_canonical IS NOT NULL"),
        ("location_precision", "location_precision IS NOT NULL"),
    ):
        add("DERIVED", field, "'rule'", where)
    known = {*MIRRORED.values(), "reporting_entity", "incident_date"}
    for f in R.REPORT_FIELDS:
        add("EVIDENCE", f, "'structured'", f"{f} IS NOT NULL" if f in known else "true", "ordered")
    add("EVIDENCE", "automation_engagement_narrative", "'narrative'", "value IS NOT NULL", "cues")
    add("EVIDENCE", "narrative_hedge", "'narrative'", "phrase IS NOT NULL", "hedges")
    return w(DRAFTS, f", a AS ({' UNION ALL '.join(parts)}) SELECT tier, field, source_type, count(*) AS atoms, count(DISTINCT candidate_id) AS candidates FROM a GROUP BY ALL").replace("\n, a AS", ", a AS")


ORACLE["e15_atoms"] = _atom_sql()


def _digest_sql(levels: int = 3) -> str:
    q = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    source = (
        """'{"source_type":"regulatory-record","external_record_id":"' || external_record_id || '","url":null,"publisher":' || """ + q("publisher")
        + """ || ',"label":"' || label || '","published_on":null,"published_on_precision":"' || published_on_precision || '","retrieved_on":"2026-09-06","note":null}'"""
    )
    parts = [
        f"n AS (SELECT event_slug, string_agg({source}, ',' ORDER BY external_record_id) AS srcs FROM sources GROUP BY 1)",
        """j AS (SELECT '{"slug":"' || slug || '","event_type":"' || event_type || '","valence":"' || valence || '","sources":[' || coalesce(srcs, '') || ']}' AS j FROM events LEFT JOIN n ON event_slug = slug)""",
        f"h{levels + 1} AS (SELECT h || ':' || count(*) AS h, count(*)::BIGINT AS n FROM (SELECT sha256(j) AS h FROM j) GROUP BY h)",
    ]
    for level in range(levels, -1, -1):
        p = f"substr(h, 1, {2 * level})"
        parts.append(f"h{level} AS (SELECT {p} || sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n)::BIGINT AS n FROM h{level + 1} GROUP BY {p})")
    return w(CORPUS, ", " + ", ".join(parts) + " SELECT n AS rows, h AS digest FROM h0").replace("\n, n AS", ", n AS")


ORACLE["a21_digest"] = _digest_sql()
ORACLE["w4_catalogue_page"] = w(
    CORPUS,
    """, f AS (SELECT e.*, coalesce(strftime(occurred_on, '%Y-%m-%d'), '') AS k, (SELECT count(*) FROM sources WHERE event_slug = slug) AS source_count FROM events e WHERE title IS NOT NULL AND event_type = 'collision'),
    n AS (SELECT greatest(1, ceil(count(*) / 50))::BIGINT AS pages FROM f)
    SELECT slug, title, source_count, least(2, pages)::INT AS page, pages::INT AS pages FROM f, n QUALIFY (row_number() OVER (ORDER BY k DESC, title COLLATE en_us, slug) - 1) // 50 + 1 = least(2, pages)""",
).replace("\n, f AS", ", f AS")
