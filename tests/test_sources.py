"""Source order over files, versions no long holds, key pages, place tables, and rows without violations."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import dates, text
from faultline.operators import catalogue, consolidate, geo, merge, quality, versions
from faultline.plans import change_queries, detail_queries, fixtures, lifecycle_queries, oracles, pipelines, queries, rule_queries, source_queries
from faultline.sources import io


def test_source_order_follows_files_not_their_sizes(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("id,t\n0,one\n")
    (tmp_path / "c.csv").write_text("id,t\n" + "".join(f'{i},"x\ny {i}"\n' for i in range(1, 40)))
    (tmp_path / "d.csv").write_text("id,t\n40,last\n")
    got = io.read_generation(spark, f"file://{tmp_path}", "current", ["id", "t"]).orderBy("src_ord").collect()
    assert [int(r.id) for r in got] == list(range(41))


def test_source_order_of_split_files(spark, tmp_path):
    for name, ids in (("b.csv", range(0, 3)), ("c.csv", range(3, 3000)), ("d.csv", range(3000, 3010))):
        (tmp_path / name).write_text("id,t\n" + "".join(f"{i},text {i}\n" for i in ids))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "4096")
        df = io.read_generation(spark, f"file://{tmp_path}", "current", ["id", "t"], multiline=False)
        assert df.rdd.getNumPartitions() > 4
        got = [int(r.id) for r in df.orderBy("src_ord").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == list(range(3010))


def test_versions_that_no_long_holds_are_reported(spark):
    rows = [("current", 1, "r", "2"), ("current", 2, "r", "9999999999999999999"), ("current", 3, "r", "0000000000000000000003"), ("current", 4, "r", "draft")]
    raw = spark.createDataFrame(rows, "generation string, src_ord long, report_id string, report_version string")
    kept, rest = versions.split_malformed_versions(raw)
    assert [r.version for r in versions.latest_version(kept).collect()] == [3]
    assert sorted(r.src_ord for r in rest.collect()) == [2, 4]


def test_key_pages_cover_all_rows_once(spark):
    ids = random.Random(2).sample(range(10_000), 1234)
    df = spark.createDataFrame([(f"s{i:05}",) for i in ids], "slug string").repartition(7)
    got = catalogue.keyset_scan(df, "slug", 50).collect()
    want = {s: n // 50 + 1 for n, s in enumerate(sorted(f"s{i:05}" for i in ids))}
    assert {r.slug: r.page for r in got} == want and len(got) == len(ids)
    after, seen = None, []
    while rows := catalogue.keyset_page(df, "slug", after, 500).collect():
        seen += [r.slug for r in rows]
        after = seen[-1]
    assert seen == sorted(want)
    assert catalogue.keyset_scan(df.limit(0), "slug").collect() == []


def test_places(spark):
    places = geo.lookup(spark)
    assert places.count() == 93 and places.select("key").distinct().count() == 93
    assert quality.violations(places, "key", quality.lookup_constraints()).count() == 0
    wrong = places.withColumn("latitude", F.lit(91.0)).withColumn("level", F.lit("city"))
    assert {r.rule for r in quality.violations(wrong, "key", quality.lookup_constraints()).collect()} == {"latitude", "level-shape"}
    lost = geo.overrides(spark).filter("lookup_key is not null").join(places, F.col("lookup_key") == F.col("key"), "left_anti")
    assert geo.overrides(spark).count() == 16 and lost.count() == 0


def test_every_flag_is_on_and_off(spark, sf):
    d = fixtures.drafts(spark, sf)
    names = [f[0] for f in pipelines.evidence.FLAGS]
    counts = d.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(n).alias(n) for n in names)).first()
    assert all(0 < counts[n] < counts["n"] for n in names), counts
    bases = {r.b for r in d.select(F.col("causation_status.basis").alias("b")).distinct().collect()}
    assert {"not-struck", "multi-contact", "infrastructure", "animal", "rear-end", "traffic-violation", "occupant", "standing", "hedge", "default"} <= bases
    topics = {r.topic for r in d.select(F.explode("hedge_list.topic").alias("topic")).distinct().collect()}
    assert topics == {"mechanism", "injury", "administrative", "other"}


def test_marked_reports_give_the_same_evidence(spark, sf):
    plain = pipelines.normalize(fixtures.candidates(spark, sf)).select("candidate_id", "cues", "hedge_list", "causation_status")
    marked = fixtures.drafts(spark, sf).select("candidate_id", "cues", "hedge_list", "causation_status")
    assert plain.exceptAll(marked).count() == 0 and marked.count() == plain.count()


def test_sound_rows_are_those_without_violations(spark, sf):
    d = fixtures.drafts(spark, sf).withColumn("location_precision", F.when(F.substring(F.md5("candidate_id"), 1, 1) == "a", "exact-point").otherwise("city"))
    events, _, found = pipelines.records(d)
    bad = {r.key for r in found.collect()}
    assert bad and {r.candidate_id for r in d.select("candidate_id").collect()} - {r.candidate_id for r in events.collect()} == bad


def test_snippets_and_dates(spark):
    long = "alpha " * 30 + "the hedge is here " + "omega " * 30
    rows = [(1, "it may have been"), (2, long), (3, "nothing"), (4, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.s for r in df.select("id", text.context_snippet(F.col("t"), "hedge|may have").alias("s")).collect()}
    assert got[1] == "it may have been" and got[3] == "" and not got[4]
    words = got[2].split(" ")
    assert "hedge" in words and set(words) <= {"alpha", "the", "hedge", "is", "here", "omega"} and 110 < len(got[2]) < 145
    d = spark.createDataFrame([("2024-05-17",), ("2024-13-01",), ("soon",)], "d string")
    assert [r.s for r in d.select(dates.format_iso_date(F.col("d")).alias("s")).collect()] == ["17 May 2024", "2024-13-01", "soon"]


def test_target_sets_and_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "id long")
    assert sorted(r.v for r in merge.target_set_join(df, ids(1, 3), "id").collect()) == ["a", "c"]
    for bad in (ids(1, 1), ids(1, 9)):
        with pytest.raises(ValueError, match="list"):
            merge.target_set_join(df, bad, "id")
    n = lambda *rows: spark.createDataFrame(rows, "name string, n long")
    off = quality.count_differences(n(("a", 1), ("b", 2), ("c", 3)), n(("a", 1), ("b", 5), ("d", 4))).collect()
    assert {(r.name, r.actual, r.expected) for r in off} == {("b", 2, 5), ("c", 3, None), ("d", None, 4)}
    undo = merge.undo_backfill(spark.createDataFrame([("s", "city"), ("t", "city")], "slug string, location_precision string"), spark.createDataFrame([("s",)], "slug string"))
    assert {(r.slug, r.location_precision) for r in undo.collect()} == {("s", "unknown"), ("t", "city")}


def test_entities_of_groups(spark, sf):
    c = fixtures.candidates(spark, sf)
    several = consolidate.cross_entity_groups(c)
    assert several.count() == consolidate.group_size_stats(c).first().cross_entity > 0
    assert all(len(set(r.entities)) > 1 for r in several.limit(20).collect())


def test_every_query_has_its_sql():
    without = {*queries.QUERIES} - {*oracles.ORACLE, *lifecycle_queries.ORACLE}
    assert not without
    assert {*lifecycle_queries.QUERIES} <= {*lifecycle_queries.ORACLE}
    for part in (source_queries, rule_queries, change_queries, detail_queries):
        assert {*part.QUERIES} == {*part.ORACLE}
