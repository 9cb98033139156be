"""What queries leave on disk: written tables, and shuffles of steps that have ended."""

import datetime as dt
import re
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__

from faultline.operators import consolidate, evidence, merge, rule_table
from faultline.plans import fixtures, lifecycle_queries, pipelines, rule_queries
from faultline.sources import io


def tables(spark) -> int:
    return len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("table-*")))


def rows(df) -> list:
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["e1_rule_cues", "e2_rule_hedges"])
def test_reports_are_read_without_grouping_them(spark, sf, name):
    """Cues and hedges of reports need no candidates: no table is written, and other fields of reports are not shuffled."""
    before = tables(spark)
    df = __spark_entry__.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert tables(spark) == before
    assert "narrative" in plan and not any(c in plan for c in ("city", "crash_with", "operating_entity", "incident_date"))


def test_cues_by_report_are_those_of_candidates(spark, sf):
    reports = pipelines.latest_reports(fixtures.raw_reports(spark, sf), "reporting_generation", "report_id", "same_incident_id", "narrative")
    got = rule_table.text_evidence(rule_table.report_texts(reports), rule_table.rule_table(spark).filter("kind <> 'flag'"))
    want = evidence.report_cues(fixtures.candidates(spark, sf))
    cues = got.filter("cue is not null").select("candidate_id", "ord.generation", "ord.report_id", "cue.value", "cue.text")
    assert rows(cues) == rows(want.select("candidate_id", F.explode("cues").alias("c")).select("candidate_id", "c.*"))
    hedges = got.select("candidate_id", "ord.generation", "ord.report_id", F.explode("hedges").alias("h"))
    hedges = hedges.select("candidate_id", "generation", "report_id", "h.topic", "h.phrase")
    told = want.select("candidate_id", F.explode("hedge_list").alias("h")).select("candidate_id", "h.generation", "h.report_id", "h.topic", "h.phrase")
    assert rows(hedges) == rows(told) and told.count() > 0


def test_named_fields_of_reports_are_those_of_all(spark, sf):
    raw = fixtures.raw_reports(spark, sf)
    fields = ("reporting_generation", "report_id", "developer_or_operator", "incident_date", "malformed_incident_date", "first_ord")
    some = pipelines.latest_reports(raw, *fields)
    assert some.columns == list(fields)
    assert rows(some) == rows(pipelines.latest_reports(raw).select(*fields))


def shuffle_files(spark) -> int:
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.endswith(".data") and f.startswith("shuffle_") for f in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())))


def test_written_tables_leave_no_shuffles(spark):
    before = shuffle_files(spark)
    kept = io.CLEANUP, spark.conf.get(io.CLEANUP)
    t = io.stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they are removed in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(io.CLEANUP) == kept[1] and t.count() == 7


def test_reports_are_shuffled_as_rows(spark, sf):
    """One shuffle of reports by candidate, before anything of a group is gathered."""
    reports = spark.createDataFrame(pipelines.latest_reports(fixtures.raw_reports(spark, sf)).limit(50).collect(), pipelines.latest_reports(fixtures.raw_reports(spark, sf)).schema)
    plan = consolidate.build_candidates(reports)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(candidate_id") == 1
    assert "collect_list" not in plan[plan.index("Exchange hashpartitioning(candidate_id") :]


def test_rule_evidence_joins_candidates_as_they_lie(spark, sf):
    """c_rule_table shuffles reports by candidate, and neither candidates nor evidence after that."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        plan = rule_queries.c_rule_table(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    by = re.findall(r"Exchange hashpartitioning\(candidate_id\S*, \d+\), (\w+)", plan)
    assert by and set(by) == {"REPARTITION_BY_COL"}


def test_corpus_deletes_its_written_reports(spark, sf):
    before = tables(spark)
    e, s = fixtures.corpus(spark, sf)
    assert tables(spark) - before == 2 and e.count() > 0 and s.count() > 0  # candidates and events
    with pytest.raises(ValueError):
        io.discard(spark.read.parquet(f"{sf}/nation.parquet"))


def test_unlike_rows(spark):
    kind = "k long, a string, t timestamp, x double, n array<string>"
    at = dt.datetime(2026, 1, 1, 0, 0, 0, 1)
    before = spark.createDataFrame([(1, "a", at, 0.0, ["u"]), (2, None, None, None, None), (3, "null", None, 1.5, []), (4, "b", at, 2.0, [None])], kind)
    after = spark.createDataFrame([(1, "a", at.replace(microsecond=2), 0.0, ["u"]), (2, None, None, None, None), (3, None, None, 1.5, []), (4, "b", at, 2.0, [None])], kind)
    cols = ["a", "t", "x", "n"]
    assert rows(merge.unlike_rows(before, after, "k", cols)) == rows(merge.snapshot_diff(before, after, "k", cols).select("k")) == ["Row(k=1)", "Row(k=3)"]
    assert merge.unlike_rows(before, before, "k", cols).isEmpty()


def test_batch_joins_fixed_columns_once(spark, sf, monkeypatch):
    """Of the two snapshots that publishing compares, rows are joined as fingerprints."""
    seen = []
    monkeypatch.setattr(merge, "snapshot_diff", lambda *a: seen.append(a))
    assert lifecycle_queries.w6_publication_batch(spark, sf).count() > 0 and not seen
