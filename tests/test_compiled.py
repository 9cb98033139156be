"""Failing checks and required texts: compiled arrays, dates parsed once, texts sought from their rarest letter."""

from pyspark.sql import functions as F

from faultline.functions import text
from faultline.functions.patterns import required_texts
from faultline.operators import quality, versions
from faultline.operators import rules_data as R
from faultline.plans import fixtures


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_violations_need_no_lambda(spark):
    rows = spark.createDataFrame([(1, True, None), (2, None, True), (3, False, False), (4, True, True)], "id int, a boolean, b boolean")
    checked = quality.with_violations(rows, [quality.Check("a", F.col("a"), F.lit(None).cast("string")), quality.Check("b", F.col("b"), "said")])
    assert {r.id: [tuple(v) for v in r.violations] for r in checked.collect()} == {1: [("a", "a")], 2: [("b", "said")], 3: [], 4: [("a", "a"), ("b", "said")]}
    assert "lambda" not in optimized(checked)


def test_a_date_is_parsed_once(spark, sf):
    raw = versions.latest_version(fixtures.raw_reports(spark, sf).withColumn("version", F.lit(1)))
    plan = optimized(versions.map_report(raw).select("incident_date", "incident_date_precision", "malformed_incident_date"))
    assert plan.count("dd-MMM-yyyy") == 1


def test_needed_texts_are_parts_of_required_ones():
    assert text.needed_texts((r"\balleged\b", r"\bstopped\b")) == ("lleged", "pped")
    for patterns in (R.ENGAGED, R.NOT_ENGAGED, R.INFRASTRUCTURE, R.OTHER_ACTOR, R.AUTOMATION_FIRST):
        needed = text.needed_texts(patterns)
        assert all(any(n in t for n in needed) for p in patterns for t in required_texts(p))
