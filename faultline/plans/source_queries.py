"""Queries over readers, writers, expressions, filters, joins and lists, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dates, text
from ..operators import catalogue, consolidate, dedupe, dictionary, geo, merge, quality
from ..operators import rules_data as R
from ..sources import io
from . import fixtures
from .fixtures import table
from .oracles import CANDIDATES, CORPUS, MAP, URL_KEY, w

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    return f"{io.shared_dir(spark)}/written-{uuid.uuid4().hex}"


DOC_COLUMNS = ["doc_id", "lang", "source", "text"]


def written_generation(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as quoted CSV files, whose texts hold commas, quotes and line breaks, read back as a generation."""
    path = scratch(spark)
    docs = table(spark, sf, "documents").select(*DOC_COLUMNS).repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    docs.write.options(header=True, quoteAll=True, escape='"', emptyValue="", **keep).csv(path)
    return io.read_generation(spark, path, "current", DOC_COLUMNS)


@query("SELECT doc_id::VARCHAR AS doc_id, lang, source, nullif(text, '') AS text, 'current' AS generation FROM documents")
def s1_read_generation(spark: SparkSession, sf: str) -> DataFrame:
    g = written_generation(spark, sf)
    return g.select("doc_id", "lang", "source", F.nullif("text", F.lit("")).alias("text"), "generation")


@query(
    """SELECT lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, 0::BIGINT AS out_of_order FROM documents GROUP BY lang"""
)
def s2_source_order(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in order of their ids: the first and the last by source order, and rows that stand before a smaller id."""
    g = written_generation(spark, sf).select("lang", F.col("doc_id").cast("long").alias("id"), "src_ord")
    # Cut by id, so that no task holds all rows; each cut also has the first row of the next one.
    cut = F.floor(F.col("id") / 1000)
    before = g.groupBy(cut.alias("cut")).agg(F.max("src_ord").alias("last"), F.min("src_ord").alias("first"))
    wrong = before.alias("a").join(before.alias("b"), F.col("b.cut") == F.col("a.cut") + 1).filter("a.last >= b.first").count()
    byid = F.row_number().over(Window.partitionBy(cut).orderBy("id"))
    byord = F.row_number().over(Window.partitionBy(cut).orderBy("src_ord"))
    off = g.select("lang", "id", "src_ord", (byid != byord).alias("off"))
    return off.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("id", "src_ord").alias("first_id"),
        F.max_by("id", "src_ord").alias("last_id"),
        (F.count_if("off") + F.lit(wrong)).alias("out_of_order"),
    )


@query(
    """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS raw_row FROM customer"""
)
def s3_raw_row(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")
    return io.with_raw_row(table(spark, sf, "customer").select("c_custkey", "c_name", segment)).select("c_custkey", "raw_row")


@query(
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
)
def s4_nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their orders nested, written as one JSON object each and read back."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    nested = catalogue.nested_sources(o, "c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name").join(nested, "c_custkey", "left")
    path = scratch(spark)
    io.write_records(c, path)
    back = io.read_records(spark, path, c.schema)
    orders = F.coalesce(F.size("sources"), F.lit(0))
    return back.select(
        "c_custkey", "c_name", F.greatest(orders, F.lit(0)).cast("long").alias("orders"), F.array_min(F.transform("sources", lambda s: s["o_orderkey"])).alias("first_order")
    )


@query(
    """WITH v AS (SELECT 'url' AS rule FROM pages WHERE page_id % 5 = 0 OR url IS NULL UNION ALL SELECT 'text-length' FROM pages WHERE length(html) > 5000)
    SELECT rule, count(*) AS n, (SELECT count(*) FROM v) AS total FROM v GROUP BY rule"""
)
def s5_problem_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected pages and their summary as side outputs, read back together."""
    p = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp "), "url")).otherwise(F.col("url")).alias("evidence_url"),
        F.col("html").alias("what_happened"),
        F.lit("a@b.org").alias("submitter_email"),
        F.lit(None).cast("string").alias("event_date"),
    )
    found, path = quality.violations(p, "page_id", quality.submission_checks()), scratch(spark)
    io.write_problems(found, found.agg(F.count(F.lit(1)).alias("total")), path)
    total = spark.read.schema("total long").json(f"{path}/summary").first()["total"]
    problems = spark.read.schema(found.schema).json(f"{path}/problems")
    return problems.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(total))


@query(
    w(CORPUS, """SELECT candidate_id, slug AS linked_event_id, CAST('0x' || substr(slug, 8, 1) AS INT) <> 0 AS event_exists, event_type, coalesce(n, 0) AS n_sources, first_source FROM
    (SELECT candidate_id, slug, CASE WHEN CAST('0x' || substr(slug, 8, 1) AS INT) <> 0 THEN event_type END AS event_type FROM events WHERE CAST('0x' || substr(slug, 7, 1) AS INT) > 1)
    LEFT JOIN (SELECT event_slug, count(*) AS n, min(external_record_id) AS first_source FROM sources WHERE CAST('0x' || substr(event_slug, 9, 1) AS INT) > 0 GROUP BY 1) ON event_slug = slug""")
)
def s6_export_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Linked candidates; some have no link, some link an event that is not there, some events have no source."""
    e, s = fixtures.corpus(spark, sf)
    digit = lambda c, at: F.conv(F.substring(c, at, 1), 16, 10).cast("int")
    c = e.select("candidate_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("same_incident_id"), F.when(digit("slug", 7) > 1, F.col("slug")).alias("linked_event_id"))
    out = io.export_linked(c, e.filter(digit("slug", 8) != 0), s.filter(digit("event_slug", 9) > 0))
    first = F.get("sources", F.lit(0))["external_record_id"]
    return out.select("candidate_id", "linked_event_id", "event_exists", "event_type", F.size("sources").cast("long").alias("n_sources"), first.alias("first_source"))


@query("SELECT p_partkey, p_name FROM part")
def s8_read_narrow(spark: SparkSession, sf: str) -> DataFrame:
    return io.read_narrow(spark, f"{sf}/part.parquet", ["p_partkey", "p_name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def s9_lookup_by_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return io.lookup_by_key(o, "o_orderkey", o.agg(F.max("o_orderkey")).first()[0]).select("o_orderkey", "o_custkey")


@query(
    """SELECT s_suppkey, upper(trim(s_name)) || '|' || upper(n_name) || '|' || upper(r_name) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def s10_reference_data(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as places of a lookup table, keyed by name, nation and region."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("country_code"))
    n = table(spark, sf, "nation").join(r, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region_code"), "country_code")
    rows = table(spark, sf, "supplier").join(n, "s_nationkey").withColumn("city_name", F.concat(F.lit(" "), "s_name"))
    return geo.load_reference_data(rows).select("s_suppkey", "key")


@query(
    w(MAP, """SELECT slug, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']},"properties":{"slug":"' || slug || '","event_type":"' || event_type || '","valence":"' || valence || '"'
    || coalesce(',"developer_or_operator":"' || developer_or_operator || '"', '') || ',"resolved_level":"' || resolved_level || '"}}' AS feature FROM points""")
)
def s11_geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.events(spark, sf, *fixtures.MAPPED, keep=True)
    return catalogue.to_geojson_features(geo.event_map(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark)))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(CAST(o_orderdate AS DATE), '%-d %B %Y') END AS shown FROM orders")
def p8_iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", dates.format_iso_date(iso).alias("shown"))


@query(
    """SELECT o_orderpriority AS value, substr(o_orderpriority, 3) AS label, count(*) AS n, substr(o_orderpriority, 1, 1) = '5' AS missing FROM (SELECT o_orderpriority FROM orders) GROUP BY 1"""
    .replace("substr(o_orderpriority, 3) AS label", "CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN substr(o_orderpriority, 3) END AS label")
)
def p9_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the label of their priority, from a dictionary that lacks one priority; the lacking one is reported."""
    o = table(spark, sf, "orders").select("o_orderpriority")
    p = F.col("o_orderpriority")
    labels = o.distinct().filter(~p.startswith("5")).select(p.alias("value"), F.substring(p, 3, 99).alias("label"))
    out, misses = dictionary.label_of(o, labels, "o_orderpriority")
    counted = out.groupBy(p.alias("value"), "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(misses.select(p.alias("value"), F.lit(True).alias("missing")), "value", "left").na.fill(False, ["missing"])


@query(
    r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '[0-9]{4}') AS m FROM documents WHERE regexp_matches(text, '[0-9]{4}')),
    a AS (SELECT *, strpos(text, m) AS p FROM d), b AS (SELECT *, greatest(p - 60, 1) AS s, p + 64 AS e FROM a)
    SELECT doc_id, trim(regexp_extract(substr(text, 1, s - 1), '\S*$') || substr(text, s, e - s) || regexp_extract(substr(text, e), '^\S*')) AS snippet FROM b"""
)
def p24_context_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The surroundings of the first year-like number of each document."""
    d = table(spark, sf, "documents").select("doc_id", text.context_snippet(F.col("text"), "[0-9]{4}").alias("snippet"))
    return d.filter("snippet <> ''")


@query(w(CORPUS, """SELECT slug, title, strftime(occurred_on, '%Y-%m-%d') AS occurred_on, developer_or_operator, event_type, valence, origin, (SELECT count(*) FROM sources WHERE event_slug = slug) AS source_count FROM events"""))
def p26_event_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = catalogue.source_count(*fixtures.corpus(spark, sf, keep=False))
    s = catalogue.event_summary(e).withColumn("occurred_on", F.col("occurred_on").cast("string"))
    return s.select("slug", "title", "occurred_on", "developer_or_operator", "event_type", "valence", "origin", "source_count")


SUBMISSIONS = """s AS (SELECT page_id AS id, url AS evidence_url, CASE WHEN page_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status,
  CASE WHEN page_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(page_id % 300 AS INT) END AS event_date, page_id % 50 AS created, html AS what_happened,
  CASE WHEN page_id % 2 = 0 THEN 'a@b.org' END AS submitter_email, page_id % 5 AS extra FROM pages)"""


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as reader submissions."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    extra = F.expr("array_join(transform(filter(sequence(0, 5), i -> i < page_id % 5), i -> concat('https://a.example/', i)), '\n\n')")
    return p.select(
        k.alias("id"),
        F.col("url").alias("evidence_url"),
        F.when(k % 3 == 0, "accepted").otherwise("pending").alias("status"),
        F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))).alias("event_date"),
        F.timestamp_seconds(k % 50).alias("created_at"),
        F.col("html").alias("what_happened"),
        F.when(k % 2 == 0, F.lit("a@b.org")).alias("submitter_email"),
        extra.alias("additional_urls"),
    )


@query(f"WITH {SUBMISSIONS} SELECT id, evidence_url, status, strftime(event_date, '%Y-%m-%d') AS event_date, what_happened IS NOT NULL AS has_text, submitter_email IS NOT NULL AS has_email, extra AS extra_urls FROM s")
def p27_submission_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = catalogue.submission_summary(submissions(spark, sf))
    return s.withColumns({"event_date": F.col("event_date").cast("string"), "extra_urls": F.col("extra_urls").cast("long")})


@query(w(CORPUS, "SELECT slug, 'event' AS kind FROM events WHERE is_public AND origin = 'curated' UNION ALL SELECT page_id::VARCHAR, 'submission' FROM pages WHERE page_id % 3 = 0"))
def f6_public_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Public curated events, and submissions of one status."""
    e = catalogue.by_origin(catalogue.public_only(fixtures.events(spark, sf, "slug", "is_public", "origin")), "curated")
    s = catalogue.by_status(submissions(spark, sf), "accepted")
    return e.select("slug", F.lit("event").alias("kind")).unionByName(s.select(F.col("id").cast("string").alias("slug"), F.lit("submission").alias("kind")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def f7_select_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as records: returned ones are to be imported, and their status is the collection."""
    li = table(spark, sf, "lineitem")
    r = li.withColumns({"decision": F.when(F.col("l_returnflag") == "R", "import").otherwise("rejected"), "collection": F.col("l_linestatus")})
    return catalogue.select_imports(r, "F").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey::VARCHAR AS key, 'enum:buyer' AS rule, 'buyer: c' || o_custkey AS message FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def f8_unknown_enum(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose buyer is not among those of orders in progress."""
    o = table(spark, sf, "orders").withColumn("buyer", F.concat(F.lit("c"), "o_custkey"))
    known = o.filter("o_orderstatus = 'P'").select(F.col("buyer").alias("value")).distinct()
    return quality.reject_unknown_enum(o, "o_orderkey", "buyer", known)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j7_missing_expected(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return merge.missing_expected(table(spark, sf, "customer"), o, ["c_custkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j8_target_set(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly the parts that were ever returned."""
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return merge.target_set_join(table(spark, sf, "part"), ids, "p_partkey").select("p_partkey", "p_name")


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'e-' || (doc_id * 2) WHEN doc_id % 4 = 2 THEN (doc_id * 2)::VARCHAR END AS d FROM documents)
    SELECT doc_id AS id, d AS duplicate_of FROM r WHERE d IS NOT NULL AND d NOT IN (SELECT doc_id::VARCHAR FROM documents) AND d NOT IN (SELECT 'e-' || page_id FROM pages)"""
)
def j11_unresolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that name another document or a page as what they duplicate, where there is none."""
    k = F.col("doc_id")
    twice = (k * 2).cast("string")
    d = F.when(k % 4 == 1, F.concat(F.lit("e-"), twice)).when(k % 4 == 2, twice)
    r = table(spark, sf, "documents").select(k.cast("string").alias("legacy_id"), d.alias("duplicate_of"))
    pages = table(spark, sf, "pages").select(F.concat(F.lit("e-"), "page_id").alias("slug"))
    return dedupe.resolve_references(r, pages).select(F.col("legacy_id").cast("long").alias("id"), "duplicate_of")


@query(w(CANDIDATES, "SELECT candidate_id, string_agg(reporting_entity, ' / ' ORDER BY o) AS entities FROM (SELECT candidate_id, reporting_entity, min(ord) AS o FROM ordered GROUP BY ALL) GROUP BY 1 HAVING count(*) > 1"))
def a10_cross_entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = consolidate.cross_entity_groups(fixtures.candidates(spark, sf))
    return g.select("candidate_id", F.array_join("entities", " / ").alias("entities"))


@query("SELECT c_custkey AS slug, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS source_count FROM customer")
def a23_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("slug"))
    return catalogue.source_count(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("event_slug")))


LISTED = """l AS (SELECT o_orderkey::VARCHAR AS slug, o_orderpriority AS title, CASE o_orderkey % 4 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-01')
  WHEN 2 THEN strftime(CAST(o_orderdate AS DATE), '%Y-01-01') ELSE '' END AS k FROM orders)"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a list of events, dates known to the day, month or year or not at all."""
    kind = F.element_at(F.array(*map(F.lit, dates.PRECISIONS)), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    date = F.when(kind != "unknown", F.col("o_orderdate").cast("date"))
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("title"), date.alias("occurred_on"), kind.alias("occurred_on_precision"))


@query(f"WITH {LISTED} SELECT slug, title, row_number() OVER (ORDER BY k DESC, title, slug) AS place FROM l QUALIFY place <= 50")
def o1_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of the list, each row with its place."""
    first = listed(spark, sf).orderBy(*catalogue.newest_first()).limit(catalogue.PAGE_SIZE)
    place = F.row_number().over(Window.orderBy(*catalogue.newest_first()))  # over one page
    return first.select("slug", "title", place.cast("long").alias("place"))


@query(f"WITH {LISTED}, n AS (SELECT count(*) AS matched, greatest(1, ceil(count(*) / 50))::BIGINT AS pages FROM l) SELECT slug, n.*, least(7, pages) AS page FROM l, n QUALIFY (row_number() OVER (ORDER BY k DESC, title, slug) - 1) // 50 + 1 = least(7, pages)")
def o2_page(spark: SparkSession, sf: str) -> DataFrame:
    rows, counts = catalogue.page(listed(spark, sf), 7)
    return rows.select("slug", *(F.lit(v).cast("long").alias(k) for k, v in counts.items()))


@query("SELECT slug, (row_number() OVER (ORDER BY slug) - 1) // 50 + 1 AS page FROM (SELECT o_orderkey::VARCHAR AS slug FROM orders)")
def o4_keyset_scan(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.keyset_scan(listed(spark, sf).select("slug"), "slug").select("slug", F.col("page").cast("long").alias("page"))


@query("SELECT o_orderkey::VARCHAR AS slug FROM orders WHERE o_orderkey::VARCHAR > '5' ORDER BY 1 LIMIT 50")
def o4_keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page after a known key."""
    return catalogue.keyset_page(listed(spark, sf).select("slug"), "slug", "5")


@query(f"WITH {SUBMISSIONS} SELECT id, row_number() OVER (ORDER BY event_date DESC NULLS LAST, created DESC, id) AS place FROM s QUALIFY place <= 100")
def o5_queue_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred submissions of the queue, each with its place."""
    s = catalogue.queue_order(submissions(spark, sf)).limit(100)
    place = F.row_number().over(Window.orderBy(F.col("event_date").desc_nulls_last(), F.col("created_at").desc(), "id"))
    return s.select("id", place.cast("long").alias("place"))
