"""Queries over snapshots, keys, pages, duplicates and labellings that change, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue, dedupe, geo, quality
from ..sources import io
from . import fixtures
from .fixtures import table
from .lifecycle_queries import d_sql, digit
from .oracles import CORPUS, MAP, w
from .queries import BOX
from .source_queries import LISTED, listed, scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(
    """SELECT 'status_' || o_orderstatus AS name, count(*) AS actual, count(*) + 1 AS expected, true AS withdrawn FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderstatus"""
)
def v9_observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are written and counted by status in one pass; one approved count is off by one, so nothing is left of the output."""
    o = table(spark, sf, "orders")
    approved = {r[0]: r[1] for r in o.groupBy("o_orderstatus").count().collect()}
    path = scratch(spark)
    counts = {f"status_{k}": F.count_if(F.col("o_orderstatus") == k) for k in approved}
    off = io.write_counted(o, path, counts, {f"status_{k}": n + (k == "P") for k, n in approved.items()})
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(files)
    return spark.createDataFrame([(k, a, e, not there) for k, (a, e) in off.items()], "name string, actual long, expected long, withdrawn boolean")


@query(
    """SELECT to_json([CAST(l_suppkey % 7 AS VARCHAR), CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_returnflag END]) AS key, count(*) AS members
    FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) > 1"""
)
def v6_nulls_not_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """A partial unique key whose nulls are equal: rows with a null in it clash with each other."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_linenumber"), F.col("l_orderkey"), (F.col("l_suppkey") % 7).alias("a"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("b")
    )
    return quality.unique_rows(li, ["a", "b"], "l_orderkey", where="l_linenumber = 1").select("key", "members")


PARTS = """e AS (SELECT p_partkey AS id, 's-' || p_partkey AS slug, p_partkey % 4 <> 0 AS pub FROM part),
b AS (SELECT 's-' || ps AS slug, count(*) AS n FROM (SELECT p_partkey AS ps FROM part WHERE p_partkey % 5 <> 0) GROUP BY 1),
a AS (SELECT 's-' || ps AS slug, count(*) AS n FROM (SELECT p_partkey AS ps FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) GROUP BY 1),
o AS (SELECT o_orderkey AS id, o_orderstatus <> 'O' AS was, o_orderkey % 3 <> 0 AS now, o_orderkey % 3 = 1 OR o_orderkey % 11 = 0 AS stamp, o_orderkey % 11 = 0 OR o_orderstatus = 'F' AS old_stamp FROM orders)"""


@query(
    f"""WITH {PARTS} SELECT 's-' || id AS key, 'last-source-lost' AS rule FROM e WHERE pub AND id % 5 <> 0 AND id % 7 = 0
    UNION ALL SELECT slug, 'public-without-source' FROM e WHERE pub AND id % 5 = 0
    UNION ALL SELECT CAST(id AS VARCHAR), 'stamped-while-pending' FROM o WHERE stamp AND NOT now
    UNION ALL SELECT CAST(id AS VARCHAR), 'unstamped-review' FROM o WHERE NOT was AND now AND NOT stamp
    UNION ALL SELECT CAST(id AS VARCHAR), 'back-to-pending' FROM o WHERE was AND NOT now
    UNION ALL SELECT CAST(id AS VARCHAR), 'review-stamp-changed' FROM o WHERE old_stamp AND NOT stamp"""
)
def v10_three_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of events, sources and submissions in one pass."""
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    k = F.col("p_partkey")
    e = table(spark, sf, "part").select(
        k.alias("id"), F.concat(F.lit("s-"), k).alias("slug"), F.col("p_name").alias("title"), (k % 4 != 0).alias("is_public"), at.alias("first_published_at")
    )
    s = table(spark, sf, "part").filter("p_partkey % 5 <> 0").select(k, F.concat(F.lit("s-"), k).alias("event_slug"))
    o = F.col("o_orderkey")
    rows = table(spark, sf, "orders")
    row = lambda status, stamp: rows.select(o.alias("id"), F.when(status, "approved").otherwise("pending").alias("status"), F.when(stamp, at).alias("reviewed_at"))
    before = row(F.col("o_orderstatus") != "O", (o % 11 == 0) | (F.col("o_orderstatus") == "F"))
    after = row(o % 3 != 0, (o % 3 == 1) | (o % 11 == 0))
    found = quality.snapshot_transitions(e, e, (s, s.filter("p_partkey % 7 <> 0")), (before, after))
    return found.select("key", "rule")


@query(f"WITH {LISTED} SELECT slug, (row_number() OVER (ORDER BY k DESC, title, slug) - 1) // 50 + 1 AS page FROM l")
def o2_page_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of the list from its directory."""
    d = catalogue.page_directory(listed(spark, sf), scratch(spark))
    return d.read(spark).select("slug", (F.floor(F.col("row") / catalogue.PAGE_SIZE) + 1).alias("page"))


@query(f"WITH {LISTED}, n AS (SELECT ceil(count(*) / 50)::BIGINT AS pages FROM l) SELECT slug, pages AS page FROM l, n QUALIFY (row_number() OVER (ORDER BY k DESC, title, slug) - 1) // 50 + 1 = pages")
def o2_last_page(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest page, read from the part that holds it."""
    rows, counts = catalogue.page_directory(listed(spark, sf), scratch(spark)).page(spark, 10**9)
    return rows.select("slug", F.lit(counts["page"]).cast("long").alias("page"))


SEEK = ("1995-06-01", "3-MEDIUM", "5")


@query(
    f"""WITH {LISTED} SELECT slug, title, row_number() OVER (ORDER BY k DESC, title, slug) AS place FROM l
    WHERE k < '{SEEK[0]}' OR k = '{SEEK[0]}' AND (title > '{SEEK[1]}' OR title = '{SEEK[1]}' AND slug > '{SEEK[2]}') QUALIFY place <= 50"""
)
def o1_seek_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page after a known place in the list's own order."""
    rows = catalogue.seek_page(listed(spark, sf), SEEK)
    place = F.row_number().over(Window.orderBy(*catalogue.newest_first()))  # over one page
    return rows.select("slug", "title", place.cast("long").alias("place"))


@query(w(MAP, f"SELECT * FROM points WHERE latitude BETWEEN {BOX[0]} AND {BOX[1]} AND longitude BETWEEN {BOX[2]} AND {BOX[3]}"))
def f4_bounded_map(spark: SparkSession, sf: str) -> DataFrame:
    """All placed events in a box, the box pushed into the places and from there into the scan."""
    e = fixtures.events(spark, sf, *fixtures.MAPPED, keep=True)
    return geo.event_map_in(e, geo.overrides(spark, fixtures.OVERRIDES), geo.lookup(spark), *BOX)


@query(
    """SELECT lang, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, 0::BIGINT AS out_of_order FROM documents GROUP BY lang"""
)
def s2_row_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Parquet files in order of id, cut by Spark as it likes: for each language the ends by source order, and rows that stand before a smaller id."""
    path = scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 4096).parquet(path)
    g = io.with_row_index(spark.read.parquet(path))
    cut = F.floor(F.col("doc_id") / 1000)
    ends = g.groupBy(cut.alias("cut")).agg(F.max("src_ord").alias("last"), F.min("src_ord").alias("first"))
    wrong = ends.alias("a").join(ends.alias("b"), F.col("b.cut") == F.col("a.cut") + 1).filter("a.last >= b.first").count()
    by_id, by_ord = (F.row_number().over(Window.partitionBy(cut).orderBy(c)) for c in ("doc_id", "src_ord"))
    off = g.withColumn("off", by_id != by_ord)
    return off.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("doc_id", "src_ord").alias("first_id"),
        F.max_by("doc_id", "src_ord").alias("last_id"),
        (F.count_if("off") + F.lit(wrong)).alias("out_of_order"),
    )


@query(
    """WITH t AS (SELECT quality, lang, CASE WHEN n_chars > 2000 THEN 1 WHEN n_chars < 300 THEN 0 END AS b, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS a FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    c AS (SELECT lang AS subset, count(*) AS scored, count(*) FILTER (coalesce(a = quality, false) AND coalesce(b = quality, false)) AS kept_right, count(*) FILTER (a <> quality AND coalesce(b <> quality, true)) AS kept_wrong,
      count(*) FILTER (a = quality AND coalesce(b <> quality, true)) AS fixed, count(*) FILTER (a <> quality AND coalesce(b = quality, false)) AS regressed,
      count(*) FILTER (a <> quality AND coalesce(b <> quality, true) AND a IS DISTINCT FROM b) AS changed_wrong FROM t GROUP BY lang)
    SELECT 'quality' AS field, *, fixed - regressed AS net, round(CASE WHEN fixed + regressed = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(fixed, regressed) + 1),
      lambda k: exp(lgamma(fixed + regressed + 1) - lgamma(k + 1) - lgamma(fixed + regressed - k + 1) - (fixed + regressed) * ln(2))))) END, 6) AS p_value FROM c"""
)
def d2_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Two rules of thumb for quality, compared pair by pair by language."""
    truth = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    before = truth.select("doc_id", F.when(n > 2000, 1).when(n < 300, 0).alias("quality"))
    after = truth.select("doc_id", F.when(n > 1000, 1).otherwise(0).alias("quality"))
    return dedupe.label_transitions(truth, before, after, "doc_id", ["quality"], "lang")


FEED = """r AS (SELECT p_partkey AS id, 'https://www.example.org/p/' || CASE WHEN p_partkey % 10 = 3 AND p_partkey > 10 THEN p_partkey - 1 ELSE p_partkey END AS url, p_brand AS operator,
  DATE '2024-01-01' + CAST(p_partkey % 40 AS INT) AS occurred_on, 'P' || p_size % 3 AS place, p_type AS event_type, p_name AS title, 'A ' || lower(p_type) || ' part of size ' || p_size AS lede FROM part),
existing AS (SELECT * FROM r WHERE id % 10 <> 3), incoming AS (SELECT * FROM r WHERE id % 10 = 3), merged AS (SELECT id, id - 2 AS merged_into FROM existing WHERE id % 10 = 2 AND id > 10)"""


@query(
    f"""WITH {FEED},
    g AS (SELECT id, lower(operator) AS op, event_type, place, occurred_on AS day, list_distinct(list_concat(list_transform(range(1, greatest(length(title) - 2, 1) + 1), lambda i: 't:' || lower(title)[i:i + 2]),
      list_transform(range(1, greatest(length(lede) - 2, 1) + 1), lambda i: 'l:' || lower(lede)[i:i + 2]))) AS s FROM r),
    x AS (SELECT id, op, event_type, place, day, s, list_sum(list_transform(s, lambda v: CASE WHEN v[1] = 't' THEN 2 ELSE 1 END)) AS wt FROM g),
    p AS (SELECT a.id, b.id AS match, a.wt, b.wt AS v, list_sum(list_transform(list_intersect(a.s, b.s), lambda v: CASE WHEN v[1] = 't' THEN 2 ELSE 1 END)) AS c,
      a.place = b.place AND abs(a.day - b.day) <= 3 AS agree FROM x a JOIN x b ON a.op = b.op AND a.event_type = b.event_type AND abs(a.day - b.day) <= 14
      WHERE a.id IN (SELECT id FROM incoming) AND b.id IN (SELECT id FROM existing)),
    texts AS (SELECT id, match, CASE WHEN agree THEN 2 ELSE 3 END AS tier, c / (wt + v - c) AS score, agree AS strong FROM p WHERE c / (wt + v - c) >= 0.5),
    sig AS (SELECT i.id, e.id AS match, 2 AS tier, NULL AS score, false AS strong FROM incoming i JOIN existing e ON lower(i.operator) = lower(e.operator) AND i.place = e.place AND i.event_type = e.event_type
      AND abs(i.occurred_on - e.occurred_on) <= 3 QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY abs(i.occurred_on - e.occurred_on), e.id) = 1),
    urls AS (SELECT i.id, min(e.id) AS match, 1 AS tier, NULL AS score, true AS strong FROM incoming i JOIN existing e USING (url) GROUP BY i.id),
    best AS (SELECT * FROM (SELECT * FROM texts UNION ALL SELECT * FROM sig UNION ALL SELECT * FROM urls)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY NOT strong, tier, -coalesce(score, 0), match) = 1)
    SELECT i.id, CASE WHEN strong THEN 'attach' WHEN match IS NOT NULL THEN 'possible-duplicate' ELSE 'new' END AS disposition, coalesce(m.merged_into, match) AS match, tier, round(score, 9) AS score
    FROM incoming i LEFT JOIN best b ON i.id = b.id LEFT JOIN merged m ON m.id = b.match"""
)
def d1_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the parts as a feed against the others: by URL, signature, title and lede, with redirects followed."""
    incoming, existing, merged = feed(spark, sf)
    return dedupe.dispositions(incoming, existing, merged).withColumn("score", F.round("score", 9))


def feed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incoming, existing, merged) parts as records."""
    k = F.col("p_partkey")
    r = table(spark, sf, "part").select(
        k.alias("id"),
        F.concat(F.lit("https://www.example.org/p/"), F.when((k % 10 == 3) & (k > 10), k - 1).otherwise(k)).alias("url"),
        F.col("p_brand").alias("operator"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).alias("occurred_on"),
        F.concat(F.lit("P"), F.col("p_size") % 3).alias("place"),
        F.col("p_type").alias("event_type"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("A "), F.lower("p_type"), F.lit(" part of size "), F.col("p_size")).alias("lede"),
    )
    existing, incoming = r.filter("id % 10 <> 3"), r.filter("id % 10 = 3")
    merged = existing.filter("id % 10 = 2 and id > 10").select("id", (F.col("id") - 2).alias("merged_into"))
    return incoming, existing, merged


@query(
    """WITH i AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 3), a AS (SELECT id, CASE WHEN id <= 10 THEN id ELSE id - 3 END AS event FROM i)
    SELECT event, count(*) AS sources, count(*) FILTER (id = event) AS created FROM a GROUP BY event"""
)
def d1_attached(spark: SparkSession, sf: str) -> DataFrame:
    """The feed after its dispositions by URL alone: attached rows are sources of what they match, after redirects; others are new events."""
    incoming, existing, merged = feed(spark, sf)
    only_url = existing.withColumn("operator", F.lit(None).cast("string"))
    found = dedupe.dispositions(incoming, only_url, merged)
    events, sources = dedupe.attach_or_create(incoming, found)
    made = events.select(F.col("id").alias("event"), F.lit(1).alias("made"))
    out = sources.groupBy("event").agg(F.count(F.lit(1)).alias("sources")).join(made, "event", "left")
    return out.select("event", "sources", F.coalesce("made", F.lit(0)).cast("long").alias("created"))


MERGES = f"""win AS (SELECT substr(slug, 7, 1) AS g, min(slug) AS winner FROM events WHERE {d_sql('slug')} = 4 GROUP BY 1),
merges AS (SELECT slug AS loser, winner FROM events JOIN win ON g = substr(slug, 7, 1) WHERE {d_sql('slug')} = 3)"""


@query(
    w(CORPUS, f""", {MERGES}, n AS (SELECT coalesce(winner, event_slug) AS slug, count(DISTINCT external_record_id) AS n FROM sources LEFT JOIN merges ON event_slug = loser GROUP BY 1)
    SELECT e.slug, is_public AND winner IS NULL AS is_public, winner AS merged_into, CASE WHEN winner IS NULL THEN 'noop' ELSE 'merge' END AS action, coalesce(n, 0) AS n_sources
    FROM events e LEFT JOIN merges ON e.slug = loser LEFT JOIN n ON n.slug = e.slug""".replace("\n, win", ", win", 1))
)
def m15_merge_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one digit are merged into an event of their group: redirects, and sources that follow."""
    e, s = fixtures.corpus(spark, sf)
    group = F.substring("slug", 7, 1)
    winners = e.filter(digit("slug") == 4).groupBy(group.alias("g")).agg(F.min("slug").alias("winner"))
    merges = e.filter(digit("slug") == 3).select(F.col("slug").alias("loser"), group.alias("g")).join(winners, "g").select("loser", "winner")
    events, sources = dedupe.merge_events(e, s, merges)
    n = sources.groupBy(F.col("event_slug").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    out = events.join(n, "slug", "left")
    return out.select("slug", "is_public", "merged_into", "action", F.coalesce("n", F.lit(0)).cast("long").alias("n_sources"))
