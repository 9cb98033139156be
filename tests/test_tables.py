"""Checks broken one at a time, merges run twice, pages, maps, digests, sources."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import catalogue, dictionary, digest, geo, merge, quality
from faultline.plans import fixtures, pipelines
from faultline.sources import io
from faultline.streaming.merge_stream import merge_stream


@pytest.fixture(scope="module")
def corpus(spark, sf):
    events, sources = fixtures.corpus(spark, sf)
    return events.cache(), sources.cache()


@pytest.fixture(scope="module")
def private(corpus):
    e, s = corpus
    none = F.lit(None).cast("string")
    return e.withColumns({"is_public": F.lit(False), "title": none, "origin": F.lit("source-derived")}), s


def test_a_sound_batch_passes(private):
    assert quality.structural_qa(*private).count() == 0


@pytest.mark.parametrize(
    ("column", "value", "rule"),
    [
        ("is_public", "true", "public"),
        ("valence", "'x'", "enum:valence"),
        ("location_precision", "'exact-point'", "too-fine"),
        ("occurred_on_precision", "'unknown'", "occurred-on"),
        ("summary", "'s'", "curator-field"),
        ("observed_facts", "array('f')", "observed-facts"),
        ("system_name", "'n'", "system-field"),
    ],
)
def test_one_fault_one_rule(private, column, value, rule):
    e, s = private
    one = e.filter("occurred_on is not null").limit(1)
    own = s.join(one.select(F.col("slug").alias("event_slug")), "event_slug", "left_semi")
    assert quality.structural_qa(one, own).count() == 0
    assert {r.rule for r in quality.structural_qa(one.withColumn(column, F.expr(value)), own).collect()} == {rule}


def test_draft_rules(spark, sf):
    d = fixtures.drafts(spark, sf).cache()
    assert quality.validate_drafts(d).count() == 0
    other = d.withColumn("causation_status", F.col("causation_status").withField("value", F.lit("other-party-contributed")))
    found = {r.rule for r in quality.validate_drafts(other).collect()}
    assert found == {"22"}
    assert "4" in {r.rule for r in quality.validate_drafts(d.withColumn("system_name", F.lit("x"))).collect()}
    assert quality.hedges_carried(pipelines.evidence.extract_evidence(fixtures.candidates(spark, sf)), pipelines.evidence.atoms(d)).count() == 0


def test_merges_settle(spark, sf):
    raw = fixtures.raw_reports(spark, sf)
    r = pipelines.latest_reports(raw).drop("malformed_incident_date", "malformed_submission_date").withColumn("candidate_id", F.lit(None).cast("string"))
    first = merge.merge_reports(r.limit(0), r)
    assert {x.action for x in first.select("action").distinct().collect()} == {"insert"}
    again = merge.merge_reports(first.drop("action"), r)
    assert {x.action for x in again.select("action").distinct().collect()} == {"noop"}
    older = r.withColumn("report_version", F.col("report_version") - 1).withColumn("city", F.lit("old"))
    assert {x.action for x in merge.merge_reports(r, older).select("action").distinct().collect()} == {"noop"}
    c = fixtures.candidates(spark, sf).drop("reports", "report_keys", "disagreements")
    single = c.filter("same_incident_id is null")
    k = F.split("candidate_id", ":")
    source = single.withColumns({"reporting_generation": k[1], "report_id": k[2]})
    one = merge.merge_singletons(single.limit(0), r, source)
    two = merge.merge_singletons(one.drop("action"), r, source)
    assert {x.action for x in two.select("action").distinct().collect()} == {"noop"} and two.count() == single.count()


def test_promotion(private):
    e, s = private
    c = e.select("candidate_id", F.lit(None).cast("string").alias("linked_event_id")).cache()
    links, events, sources = merge.promote(c, e.limit(0), s.limit(0), e, s)
    assert events.count() == e.count() and sources.count() == s.count()
    merge.assert_promotion(links, events, sources)
    again = merge.promote(links, events, sources, e, s)
    assert again[1].count() == e.count()
    with pytest.raises(ValueError, match="nothing is promoted"):
        merge.promote(c, e.limit(1), s.limit(0), e, s)
    slugs = events.limit(2).select("slug").cache()
    left, left_sources, left_links = merge.delete_exact_set(events, sources, links, slugs)
    assert left.count() == e.count() - 2 and left_links.filter("linked_event_id is null").count() == 2
    assert left_sources.join(slugs.withColumnRenamed("slug", "event_slug"), "event_slug", "left_semi").count() == 0


def test_publication_batch(private):
    e, s = private
    c = e.select("candidate_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("same_incident_id"), F.col("slug").alias("linked_event_id"))
    some = e.withColumn("summary", F.when(F.substring("slug", 7, 1) == "0", "x"))
    out = pipelines.publication_batch(io.export_linked(c, some, s), some, "2026-09-10 00:00:00")
    held = some.filter("summary is not null or developer_or_operator is null").count()
    assert out["exceptions"].count() == held
    assert out["events"].filter("is_public").count() == e.count() - held
    back = merge.unpublish(out["events"].drop("action"), out["events"].filter("is_public").select("slug"))
    assert back.filter("is_public").count() == 0 and back.filter("first_published_at is null").count() == held


def test_pages(corpus):
    e, s = corpus
    full = catalogue.source_count(e, s).cache()
    seen = []
    pages = catalogue.page(full, 1)[1]["pages"]
    for n in range(1, pages + 1):
        seen += [r.slug for r in catalogue.page(full, n)[0].collect()]
    assert len(seen) == len(set(seen)) == full.count()
    assert catalogue.page(full, 10_000)[1]["page"] == pages and catalogue.page(full, "x")[1]["page"] == 1
    assert catalogue.page(full.limit(0), 3)[1] == {"matched": 0, "page": 1, "pages": 1}


def test_map_bounds(corpus):
    e, _ = corpus
    spark = e.sparkSession
    points = geo.event_map(e, geo.overrides(spark), geo.lookup(spark))
    for box in ((1, 0, 0, 1), (0, 1, 1, 0), (-91, 0, 0, 1), (0, 1, 0, 181), (float("nan"), 1, 0, 1)):
        with pytest.raises(ValueError):
            geo.filter_bounds(points, *box)
    row = catalogue.to_geojson_features(points).first()
    assert row.feature.startswith('{"type":"Feature","geometry":{"type":"Point","coordinates":[')
    with pytest.raises(ValueError, match="duplicate"):
        geo.load_reference_data(geo.lookup(spark, [*geo.PLACES, geo.PLACES[0]]))


def test_digest(corpus):
    e, s = corpus
    c = catalogue.read_corpus(e, s)
    cols = ["slug", "valence", "sources"]
    a = digest.corpus_digest(c, cols).first()
    b = digest.corpus_digest(c.orderBy(F.desc("title")).repartition(5), cols).first()
    assert a == b and a["rows"] == e.count()
    changed = c.withColumn("valence", F.when(F.col("slug") == c.first().slug, "x").otherwise(F.col("valence")))
    assert digest.corpus_digest(changed, cols).first() != a
    assert digest.corpus_digest(c.unionByName(c.limit(1)), cols).first()["rows"] == e.count() + 1


def test_dictionary(spark):
    d = dictionary.names(spark)
    assert d.select("canonical").distinct().count() == 39
    e = spark.createDataFrame([("a", "Waymo LLC"), ("b", "Unknown Co"), ("c", "Internal employee"), ("d", None)], "slug string, developer_or_operator string")
    assert [r.canonical for r in dictionary.facet_options(e, d).collect()] == ["Unknown Co", "Waymo"]
    assert dictionary.filter_raw_in(e, d, "Unknown Co").count() == 1


def test_csv_generation(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_bytes('﻿a,b,c\n1,"x, ""y""\nz",3\n4,5\n'.encode())
    got = io.read_generation(spark, f"file://{p}", "current", ["a", "b", "c"]).orderBy("src_ord").collect()
    assert [(r.a, r.b, r.c) for r in got] == [("1", 'x, "y"\nz', "3"), ("4", "5", None)]
    p.write_text("a,b,c\n1,2,3,4\n5,6,7\n")
    with pytest.raises(ValueError, match="more fields"):
        io.read_generation(spark, f"file://{p}", "current", ["a", "b", "c"])
    assert io.read_generation(spark, f"file://{p}", "current", ["a", "b", "c"], strict=False).count() == 1


def test_records_round_trip(corpus, tmp_path):
    e, s = corpus
    c = catalogue.read_corpus(e, s).select("slug", "title", "sources").limit(20).cache()
    io.write_records(c, f"file://{tmp_path}/r")
    back = io.read_records(c.sparkSession, f"file://{tmp_path}/r", c.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, c.collect()))
    assert io.lookup_by_key(c, "slug", c.first().slug).count() == 1


def test_merge_stream(spark, tmp_path):
    schema = "id long, v long"
    snaps = {"now": f"file://{tmp_path}/s"}
    spark.createDataFrame([(1, 1)], schema).write.parquet(snaps["now"])
    for i, rows in enumerate([[(1, 5), (2, 2)], [(2, 2), (3, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")

    def write(df, n):
        path = f"file://{tmp_path}/s{n}"
        df.write.mode("overwrite").parquet(path)
        snaps["now"] = path

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = merge_stream(stream, lambda: spark.read.parquet(snaps["now"]), write, lambda t, s: merge.upsert_by_key(t, s, ["id"]), f"file://{tmp_path}/cp")
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(snaps["now"]).collect())) == [(1, 5), (2, 2), (3, 3)]


def test_entry_runs_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
