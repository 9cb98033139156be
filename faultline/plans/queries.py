"""Registered queries: each applies operators to the whole fixture views or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import catalogue, consolidate, dedupe, dictionary, digest, evidence, geo, merge, quality, versions
from ..operators import events as ev
from ..sources import io
from . import fixtures, pipelines
from .fixtures import table

#: Bounds of the map query.
BOX = (30.0, 40.0, -125.0, -100.0)


def joined(c: Column | str, by: str = " / ") -> Column:
    return F.array_join(c, by)


def f1_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return versions.placeholder_counts(fixtures.raw_reports(spark, sf))


def f2_malformed_versions(spark: SparkSession, sf: str) -> DataFrame:
    bad = versions.split_malformed_versions(fixtures.raw_reports(spark, sf))[1]
    return bad.select("generation", "src_ord", "report_id", "report_version")


def a1_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    raw = versions.split_placeholders(fixtures.raw_reports(spark, sf))[0]
    latest = versions.latest_version(versions.split_malformed_versions(raw)[0])
    return latest.select("generation", "report_id", "version", "src_ord", "first_ord")


def p3_map_report(spark: SparkSession, sf: str) -> DataFrame:
    r = pipelines.latest_reports(fixtures.raw_reports(spark, sf))
    return r.drop("report_submission_date", "malformed_submission_date", "retrieved_on", "first_ord").withColumn(
        "incident_date", F.col("incident_date").cast("string")
    )


def p4_report_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return versions.report_anomalies(pipelines.latest_reports(fixtures.raw_reports(spark, sf)))


def p5_partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    kind = F.element_at(F.array(*map(F.lit, dates.PRECISIONS)), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    date = F.when(kind != "unknown", d)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        kind.alias("kind"),
        dates.legal_pair(date, kind).alias("legal"),
        dates.partial_date(date, kind).alias("partial"),
        dates.pin_to_period(date, kind).cast("string").alias("pinned"),
        dates.partial_date_sort_key(date, kind).alias("sort_key"),
        dates.format_partial_date(date, kind).alias("shown"),
    )


def a8_generation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return versions.generation_stats(fixtures.raw_reports(spark, sf))


CANDIDATE = ("candidate_id", "same_incident_id", *consolidate.MIRRORED, "incident_date_precision", "country_code", "narrative", "curator_note", "status")


def w1_build_incidents(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.candidates(spark, sf)
    return c.select(*CANDIDATE, F.col("incident_date").cast("string").alias("incident_date"), F.size("reports").cast("long").alias("n_reports"))


def a2_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of w1 from values that merge, without any array of reports; its two branches read one written table."""
    c = consolidate.consolidate(io.stored(pipelines.latest_reports(fixtures.raw_reports(spark, sf))))
    return c.select(*CANDIDATE, F.col("incident_date").cast("string").alias("incident_date"), "n_reports")


def a4_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    d = consolidate.disagreements(fixtures.candidates(spark, sf))
    return d.select("candidate_id", "field", joined("values").alias("said"))


def a9_disagreement_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate.disagreement_histogram(fixtures.candidates(spark, sf))


def a10_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return consolidate.group_size_stats(fixtures.candidates(spark, sf))


def j1_reports_of(spark: SparkSession, sf: str) -> DataFrame:
    reports = pipelines.latest_reports(fixtures.raw_reports(spark, sf))
    c = consolidate.build_candidates(reports).select("candidate_id", "report_keys")
    return consolidate.reports_of(c, reports).select("candidate_id", (F.col("ord") + 1).cast("long").alias("ord"), "report_id", "report_version")


def e1_engagement_cues(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence.report_cues(fixtures.candidates(spark, sf))
    return e.select("candidate_id", F.explode("cues").alias("c")).select("candidate_id", "c.report_id", "c.value", "c.text")


def e2_hedges(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence.report_cues(fixtures.candidates(spark, sf))
    return e.select("candidate_id", F.explode("hedge_list").alias("h")).select("candidate_id", "h.report_id", "h.topic", "h.phrase")


FLAGS = tuple(f[0] for f in evidence.FLAGS)


def e3_narrative_flags(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.narrative_flags(fixtures.candidates(spark, sf)).select("candidate_id", *FLAGS)


def e15_atoms(spark: SparkSession, sf: str) -> DataFrame:
    a = evidence.atoms(evidence.extract_evidence(fixtures.candidates(spark, sf)))
    return a.groupBy("tier", "field", "source_type").agg(F.count(F.lit(1)).alias("atoms"), F.count_distinct("candidate_id").alias("candidates"))


def e16_field_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = evidence.field_evidence(fixtures.candidates(spark, sf))
    return e.select(
        "candidate_id",
        joined(F.transform("conflicts", lambda d: d["field"]), ",").alias("conflicts"),
        "developer_canonical",
        "city_canonical",
        "inconsistent",
        "location_precision",
    )


LABELS = ("automation_status", "causation_status", "event_type", "valence")


def c_classify(spark: SparkSession, sf: str) -> DataFrame:
    return labels(fixtures.drafts(spark, sf))


def labels(d: DataFrame) -> DataFrame:
    return d.select(
        "candidate_id",
        *(F.col(f"{x}.value").alias(x) for x in LABELS),
        *(F.col(f"{x}.confidence").alias(f"{x}_confidence") for x in LABELS),
        joined(F.coalesce("scenario_tags.value", F.array().cast("array<string>")), ",").alias("tags"),
        F.size("unknowns").cast("long").alias("n_unknowns"),
    )


def w2_events(spark: SparkSession, sf: str) -> DataFrame:
    e = pipelines.records(fixtures.drafts(spark, sf))[0]
    return e.select(
        "slug", "candidate_id", "location_text", "location_precision", "developer_or_operator", "event_type", "valence",
        "automation_status", "causation_status", "occurred_on_precision", F.col("occurred_on").cast("string").alias("occurred_on"),
        "is_public",
    )


def p15_event_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.to_event_source(fixtures.candidates(spark, sf))
    return s.select("event_slug", "external_record_id", "publisher", "label", "published_on_precision")


def p16_titles(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.events(spark, sf, "slug", "title")


def v1_draft_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts, of which one in eight has too fine a place, one in eight an unknown type, and one in eight no unknowns."""
    d = fixtures.drafts(spark, sf).withColumn("k", F.pmod(F.conv(F.substring(F.md5("candidate_id"), 1, 4), 16, 10).cast("int"), F.lit(8)))
    t = F.col("event_type")
    d = d.withColumns(
        {
            "location_precision": F.when(F.col("k") == 0, "exact-point").otherwise(F.col("location_precision")),
            "event_type": F.when(F.col("k") == 1, t.withField("value", F.lit("crash"))).otherwise(t),
            "unknowns": F.when(F.col("k") == 2, F.array().cast("array<string>")).otherwise(F.col("unknowns")),
        }
    )
    return quality.validate_drafts(d).select("key", "rule")


def broken(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The corpus with faults put in by the slug's digits."""
    e, s = fixtures.corpus(spark, sf)
    n = F.conv(F.substring("slug", 8, 2), 16, 10).cast("int")
    e = e.withColumns(
        {
            "summary": F.when(n % 16 == 0, F.lit(" ")),
            "valence": F.when(n % 16 == 1, F.lit("bad")).otherwise(F.col("valence")),
            "developer_or_operator": F.when(n % 16 == 2, F.lit(None)).otherwise(F.col("developer_or_operator")),
            "occurred_on": F.when(n % 16 == 3, F.lit(None)).otherwise(F.col("occurred_on")),
            "record_updated": F.when(n % 16 == 4, F.lit(None)).otherwise(F.col("record_updated")),
        }
    )
    m = F.conv(F.substring("event_slug", 8, 2), 16, 10).cast("int")
    s = s.filter(m % 16 != 5).withColumn("external_record_id", F.when(m % 16 == 6, F.lit("x")).otherwise(F.col("external_record_id")))
    return e, s


def v2_structural_qa(spark: SparkSession, sf: str) -> DataFrame:
    e, s = broken(spark, sf)
    return quality.structural_qa(e, s).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def a20_qa_counters(spark: SparkSession, sf: str) -> DataFrame:
    e, s = broken(spark, sf)
    return quality.qa_counters(quality.structural_marks(e, s))


def v3_publication(spark: SparkSession, sf: str) -> DataFrame:
    e, s = broken(spark, sf)
    c = e.select("candidate_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("same_incident_id"), F.col("slug").alias("linked_event_id"))
    found = quality.publication_preconditions(io.export_linked(c, e, s))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def v5_row_constraints(spark: SparkSession, sf: str) -> DataFrame:
    e, _ = broken(spark, sf)
    return quality.violations(e, "slug", quality.row_constraints()).select("key", "rule")


def v6_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of line items that several rows hold."""
    li = table(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return quality.duplicate_keys(li, "k", "l_partkey").select("key", "members")


def v6_references(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that no label refers to, as references without a target."""
    docs = table(spark, sf, "documents").select("doc_id")
    return quality.missing_references(docs, "doc_id", "doc_id", table(spark, sf, "labels"), "doc_id", "unlabelled").select("key", "rule")


def v7_completeness(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.completeness(*broken(spark, sf))
    return out.select("slug", "origin", joined("missing", ",").alias("missing"))


def v8_corpus_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return quality.corpus_invariants(*broken(spark, sf)).select("key", "rule")


def report_snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two of three reports as target; all as source, one in five of them a version higher, one in seven in another city."""
    r = pipelines.latest_reports(fixtures.raw_reports(spark, sf)).drop("malformed_incident_date", "malformed_submission_date")
    target = r.filter("first_ord % 3 <> 0").withColumn("candidate_id", F.lit(None).cast("string"))
    source = r.withColumn("report_version", F.col("report_version") + (F.col("first_ord") % 5 == 0).cast("int"))
    return target, source.withColumn("city", F.when(F.col("first_ord") % 7 == 0, "Elsewhere").otherwise(F.col("city")))


def m1_merge_reports(spark: SparkSession, sf: str) -> DataFrame:
    out = merge.merge_reports(*report_snapshots(spark, sf))
    return out.select("reporting_generation", "report_id", "report_version", "city", "action")


def m2_merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.candidates(spark, sf).filter("same_incident_id is not null").drop("reports", "report_keys", "disagreements")
    n = F.substring("same_incident_id", 2, 9).cast("long")
    target = c.filter(n % 3 != 0).withColumn("status", F.when(n % 4 == 0, "approved").otherwise("pending"))
    source = c.withColumn("state", F.when(n % 8 == 0, "NV").otherwise(F.col("state")))
    return merge.merge_candidates(target, source).select("same_incident_id", "state", "status", "action")


def m3_merge_singletons(spark: SparkSession, sf: str) -> DataFrame:
    """Reports without an incident: half are linked to a candidate from before, of which half have other data, half of those reviewed."""
    c = fixtures.candidates(spark, sf).filter("same_incident_id is null")
    k = F.get("report_keys", F.lit(0))
    source = c.withColumns({"reporting_generation": k["generation"], "report_id": k["report_id"]}).drop("reports", "report_keys", "disagreements")
    digit = F.conv(F.substring(F.md5("candidate_id"), 1, 1), 16, 10).cast("int")
    old = source.filter(digit % 2 == 0).withColumns(
        {
            "city": F.when(digit % 4 == 0, F.lit("Elsewhere")).otherwise(F.col("city")),
            "status": F.when(digit % 8 == 0, F.lit("approved")).otherwise(F.lit("pending")),
        }
    )
    links = old.select("reporting_generation", "report_id", "candidate_id")
    reports = pipelines.latest_reports(fixtures.raw_reports(spark, sf)).join(links, ["reporting_generation", "report_id"], "left")
    out = merge.merge_singletons(old.drop("reporting_generation", "report_id"), reports, source)
    return out.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))


def m9_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All parts on one side or both: two of three in the target, and in the source those that it lacks and four of five others."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    target = p.filter("p_partkey % 3 <> 0")
    source = p.filter("p_partkey % 3 = 0 or p_partkey % 5 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, "renamed").otherwise(F.col("p_name")))
    return merge.upsert_by_key(target, source, ["p_partkey"])


def m10_delete(spark: SparkSession, sf: str) -> DataFrame:
    e, s = fixtures.corpus(spark, sf)
    c = e.select("candidate_id", F.col("slug").alias("linked_event_id"))
    gone = e.filter(F.substring("slug", 6, 1) == "0").select("slug")
    kept, sources, links = merge.delete_exact_set(e, s, c, gone)
    return kept.agg(F.count(F.lit(1)).alias("events")).withColumns(
        {"sources": F.lit(sources.count()), "links": F.lit(links.filter("linked_event_id is not null").count())}
    )


def m7_publish(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "title", "is_public", "first_published_at")
    e = e.withColumn("is_public", F.lit(False))
    batch = e.filter(F.substring("slug", 6, 1) < "8").select("slug", "title")
    out = merge.publish(e.withColumn("title", F.lit(None).cast("string")), batch, "2026-09-10 00:00:00")
    return out.select("slug", "title", "is_public", "action", F.col("first_published_at").isNotNull().alias("stamped"))


def m11_backfill(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "location_text", "location_country_code", "origin")
    e = e.withColumns({"location_precision": F.lit("unknown")})
    return merge.backfill_where_unknown(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark)).select("slug", "location_precision", "action")


def m13_submissions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("evidence_url"))
    p = p.withColumns(
        {
            "status": F.when(F.col("id") % 3 == 0, "accepted").otherwise("pending"),
            "linked_event_id": F.when(F.col("id") % 9 == 0, "known"),
            "what_happened": F.lit(None).cast("string"),
            "developer_or_operator": F.lit(None).cast("string"),
            "location_text": F.lit(None).cast("string"),
        }
    )
    return merge.convert_submissions(p)[2].select("id", "status", "linked_event_id")


def m14_reviews(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    reviews = t.filter("role <> 'system'").select(
        F.col("conv_id").alias("id"),
        F.col("turn").alias("ord"),
        F.when(F.col("role") == "user", "pending").otherwise("accepted").alias("status"),
        F.concat(F.lit("r"), F.col("turn")).alias("reviewer"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("reviewed_at"),
    )
    none = F.lit(None)
    subs = t.select(F.col("conv_id").alias("id")).distinct().withColumns(
        {"status": F.lit("pending"), "reviewer": none.cast("string"), "reviewed_at": none.cast("timestamp")}
    )
    return merge.apply_reviews(subs, reviews).select("id", "status", "reviewer", "action")


def j2_link_reports(spark: SparkSession, sf: str) -> DataFrame:
    r = pipelines.latest_reports(fixtures.raw_reports(spark, sf))
    c = consolidate.build_candidates(r).select("candidate_id", "same_incident_id")
    linked = merge.link_reports(r.withColumn("candidate_id", F.lit(None).cast("string")), c)
    return linked.select("report_id", "reporting_generation", "candidate_id", "changed")


def j3_classify_writes(spark: SparkSession, sf: str) -> DataFrame:
    target, source = report_snapshots(spark, sf)
    return merge.classify_writes(source, target)


def j9_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    r, s = report_snapshots(spark, sf)
    k = F.concat_ws(":", "reporting_generation", "report_id")
    out = merge.snapshot_diff(r.withColumn("k", k), s.withColumn("k", k), "k", ["report_version", "city", "state"])
    return out.select("k", joined("changed", ",").alias("changed"))


def j6_children(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    have = merge.has_child(docs, labels, "doc_id", "doc_id").select("doc_id", F.lit(True).alias("labelled"))
    return have.unionByName(merge.lacks_child(docs, labels, "doc_id", "doc_id").select("doc_id", F.lit(False).alias("labelled")))


def u3_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, and customers with orders: those that one side lacks; some orders name a customer that is not there."""
    k = F.col("o_custkey")
    named = table(spark, sf, "orders").select(F.when(k % 7 == 0, -k).otherwise(k).alias("custkey"))
    return merge.set_difference(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), named)


def v10_transitions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    row = lambda slug, public, at: p.withColumns({"slug": slug, "is_public": public, "first_published_at": at})
    k, none = F.col("id"), F.lit(None).cast("timestamp")
    before = row(F.concat(F.lit("s-"), k), k % 2 == 0, F.when(k % 2 == 0, stamp)).filter("id % 11 <> 0")
    slug = F.when(k % 5 == 0, F.concat(F.lit("t-"), k)).otherwise(F.concat(F.lit("s-"), k))
    after = row(slug, k % 3 != 0, F.when(k % 2 == 0, stamp).otherwise(none)).filter("id % 13 <> 0")
    return quality.snapshot_transitions(before, after).select("key", "rule")


def v11_submissions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp "), "url")).otherwise(F.col("url")).alias("evidence_url"),
        F.col("html").alias("what_happened"),
        F.when(F.col("page_id") % 7 == 0, F.lit("nobody")).otherwise(F.lit("a@b.org")).alias("submitter_email"),
        F.when(F.col("page_id") % 3 == 0, F.lit("2024-02-30")).otherwise(F.lit("2024-02-28")).alias("event_date"),
    )
    return quality.violations(p, "page_id", quality.submission_checks()).select("key", "rule")


def w3_event_map(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, *fixtures.MAPPED, keep=True)
    return geo.event_map(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark))


def a16_resolution_report(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, *fixtures.MAPPED, keep=True)
    return geo.resolution_report(e, geo.event_map(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark)))


def a17_before_after(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "location_text", "location_country_code", "origin", keep=True)
    before = e.withColumn("location_precision", F.lit("unknown"))
    after = merge.backfill_where_unknown(before, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark))
    return geo.before_after(before, after, "slug", "location_precision")


def w5_map_query(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, *fixtures.MAPPED, keep=True)
    return pipelines.map_query(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark), dictionary.names(spark), BOX, valence="neutral-or-unclear", name="Waymo")


def j10_canonical(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "developer_or_operator")
    return dictionary.canonicalise(e, dictionary.names(spark)).select("slug", "canonical")


def a12_facets(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.facet_options(fixtures.events(spark, sf, "developer_or_operator"), dictionary.names(spark))


def a13_canonical_counts(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.canonical_counts(fixtures.events(spark, sf, "developer_or_operator"), dictionary.names(spark))


def a14_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.dictionary_coverage(dictionary.names(spark), fixtures.events(spark, sf, "developer_or_operator", keep=True))


def f3_filter_events(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "event_type", "valence", "developer_or_operator")
    return dictionary.filter_events(e, dictionary.names(spark), "collision", "neutral-or-unclear", "WAYMO LLC").select("slug")


def f5_filter_raw(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "developer_or_operator", keep=True)
    return dictionary.filter_raw_in(e, dictionary.names(spark), "Waymo").select("slug", "developer_or_operator")


def w4_catalogue_page(spark: SparkSession, sf: str) -> DataFrame:
    e, s = fixtures.corpus(spark, sf)
    corpus = catalogue.source_count(e.filter("title is not null"), s)
    found = pipelines.catalogue_page(corpus, dictionary.names(spark), 2, event_type="collision")
    return found["rows"].select("slug", "title", "source_count").withColumns({"page": F.lit(found["page"]), "pages": F.lit(found["pages"])})


def s7_read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    c = catalogue.read_corpus(*fixtures.corpus(spark, sf, keep=False))
    return c.select("slug", F.size("sources").cast("long").alias("n"), joined(F.transform("sources", lambda s: s["external_record_id"]), ",").alias("ids"))


def a11_valence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.valence_stats(fixtures.events(spark, sf, "valence"))


def a18_cube(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("collection"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("decision"))
    return pipelines.decision_report(o.join(c, "c_custkey"))


def a21_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest.corpus_digest(catalogue.read_corpus(*fixtures.corpus(spark, sf, keep=False)), ["slug", "event_type", "valence", "sources"])


def p12_hash_slugs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.hash_slug("nhtsa-", F.col("p_name")).alias("slug"), text.slugify(F.col("p_name")).alias("plain"))


def p18_title_slugs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("legacy_id"), F.col("text").alias("title"))
    none = spark.createDataFrame([("none",)], "slug string")
    return dedupe.title_slugs(d, "title", none).select("legacy_id", "slug", "method")


def p19_part_slugs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("legacy_id"), text.slugify(F.col("p_name")).alias("raw_slug"), F.lit("full").alias("method"))
    none = spark.createDataFrame([("none",)], "slug string")
    return dedupe.disambiguate_slugs(p, none).select("legacy_id", "slug", "method")


def p20_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url_key"))


def p22_url_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = F.concat_ws("\n", "url", F.lit(" note "), F.lit(""), F.lit("https://a.example/x"))
    lines = text.url_lines(c)
    return table(spark, sf, "pages").select("page_id", F.size(lines).cast("long").alias("lines"), joined(F.transform(lines, lambda x: x["href"]), " ").alias("hrefs"))


def j12_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    own = p.select(F.col("page_id").alias("legacy_id"), "url", F.when(F.col("page_id") % 4 == 0, F.col("page_id").cast("string")).alias("media_id"))
    known = p.filter("page_id % 6 = 0").select(F.concat(F.lit("e-"), "page_id").alias("slug"), "url", F.col("page_id").cast("string").alias("media_id"))
    return dedupe.exact_duplicates(own, known)


def j13_frozen_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("legacy_id"), text.slugify(F.col("p_name")).alias("slug"))
    now = p.filter("legacy_id % 10 <> 0").withColumn("slug", F.when(F.col("legacy_id") % 7 == 0, "moved").otherwise(F.col("slug")))
    return merge.frozen_key_changes(p, now)


def d1_duplicate_tiers(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, "slug", "developer_or_operator", "occurred_on", "location_text", "event_type", "title", keep=True)
    return dedupe.duplicate_tiers(
        e.select(F.col("slug").alias("id"), F.concat(F.lit("https://www.example.org/r/"), F.substring("slug", 8, 4), F.lit("/?from=feed")).alias("url"), F.col("developer_or_operator").alias("operator"),
                 "occurred_on", F.col("location_text").alias("place"), "event_type", "title")
    )


def d2_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A rule of thumb for quality, scored against the labels by language."""
    truth = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    guess = truth.select("doc_id", F.when(F.col("n_chars") > 2000, 1).when(F.col("n_chars") < 300, 0).alias("quality"))
    return dedupe.score_labels(truth, guess, "doc_id", ["quality"], "lang")


QUERIES = {
    f.__name__: f
    for f in (
        w1_build_incidents, a2_consolidate, f1_placeholders, f2_malformed_versions, a1_latest_version, p3_map_report, p4_report_anomalies,
        p5_partial_dates, a8_generation_stats, a4_disagreements, a9_disagreement_histogram, a10_group_stats, j1_reports_of,
        e1_engagement_cues, e2_hedges, e3_narrative_flags, e15_atoms, e16_field_evidence, c_classify, w2_events,
        p15_event_sources, p16_titles, v1_draft_violations, v2_structural_qa, a20_qa_counters, v3_publication,
        v5_row_constraints, v6_keys, v6_references, v7_completeness, v8_corpus_invariants, v10_transitions, v11_submissions,
        m1_merge_reports, m2_merge_candidates, m3_merge_singletons, m7_publish, m9_upsert, m10_delete, m11_backfill,
        m13_submissions, m14_reviews, j2_link_reports, j3_classify_writes, j6_children, j9_snapshot_diff, u3_set_difference,
        w3_event_map, a16_resolution_report, a17_before_after, w5_map_query, j10_canonical, a12_facets, a13_canonical_counts,
        a14_coverage, f3_filter_events, f5_filter_raw, w4_catalogue_page, s7_read_corpus, a11_valence_stats, a18_cube,
        a21_digest, p12_hash_slugs, p18_title_slugs, p19_part_slugs, p20_urls, p22_url_lines, j12_exact_duplicates,
        j13_frozen_keys, d1_duplicate_tiers, d2_scores,
    )
}
