"""Evidence rules on short sentences of our own: each fires, and its negative control does not."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline.functions import dates, text
from faultline.operators import classify, consolidate, evidence
from faultline.operators import rules_data as R
from faultline.plans import fixtures, pipelines

RAW = (
    "generation string, src_ord long, report_id string, report_version string, report_type string, same_incident_id string, "
    "reporting_entity string, operating_entity string, incident_date string, city string, state string, engagement_status string, "
    "crash_with string, sv_movement string, cp_movement string, injury string, narrative string"
)


def row(**over):
    base = dict(
        generation="current", src_ord=1, report_id="r1", report_version="1", report_type="Incident", same_incident_id="i1",
        reporting_entity="Acme", operating_entity=None, incident_date="MAY-2024", city="Phoenix", state="AZ",
        engagement_status=None, crash_with="Passenger Car", sv_movement=None, cp_movement=None, injury=None, narrative=None,
    )
    base.update(over)
    return tuple(base.values())


def drafts(spark, *rows):
    return pipelines.normalize(pipelines.build_incidents(spark.createDataFrame([row(**r) for r in rows], RAW)))


FLAG_CASES = [
    ("multi_contact", "A van struck a bus, the bus struck a car, and the car collided with the AV.", True),
    ("multi_contact", "A van struck a bus and the bus struck a car.", False),
    ("no_contact", "There was no contact with the cone.", True),
    ("rear_ended", "A truck struck the rear of the Acme AV.", True),
    ("rear_ended", "The AV struck the rear of a truck.", False),
    ("emergency_response", "An engine with lights and sirens passed.", True),
    ("handled_well", "The AV braked and came to a stop. A bike made contact with the stopped AV.", True),
    ("handled_well", "The AV braked. A bike made contact with the AV.", False),
    ("not_struck", "The AV did not move. One passenger vehicle hit another passenger vehicle, which sustained damage.", True),
    ("traffic_violation", "A car ran the red light.", True),
    ("traffic_violation", "A red car passed on a green light.", False),
    ("lane_intrusion", "A car entered the AV's lane of travel.", True),
    ("automation_first", "The ADS initiated a turn and then the operator took over.", True),
    ("human_first", "The safety driver took over and the AV met a fence.", True),
    ("human_first", "After the impact, the safety driver took over.", False),
    ("human_untimed", "After the impact, the safety driver took over.", True),
    ("human_first", "It was late. The driver took over after the collision.", True),
    ("occupant_action", "A passenger opened the rear left door.", True),
    ("occupant_action", "A passenger of the parked vehicle opened the rear left door.", False),
]


def test_flags(spark):
    d = drafts(spark, *(dict(src_ord=i, report_id=f"r{i}", same_incident_id=f"i{i}", narrative=n) for i, (_, n, _) in enumerate(FLAG_CASES)))
    got = {r["candidate_id"]: r for r in d.select("candidate_id", *(f[0] for f in evidence.FLAGS)).collect()}
    for i, (flag, narrative, want) in enumerate(FLAG_CASES):
        assert got[f"same-incident:i{i}"][flag] is want, (flag, narrative)


def test_infrastructure_needs_no_other_party(spark):
    say = "The AV made contact with a curb."
    cases = [(None, say, True), ("Other Fixed Object", say, True), ("Passenger Car", say, False), (None, "A truck struck the parked AV at the curb.", False)]
    d = drafts(spark, *(dict(src_ord=i, report_id=f"r{i}", same_incident_id=f"i{i}", crash_with=c, narrative=n) for i, (c, n, _) in enumerate(cases)))
    got = {r.candidate_id: r.infrastructure for r in d.collect()}
    assert [got[f"same-incident:i{i}"] for i in range(len(cases))] == [c[2] for c in cases]


@pytest.mark.parametrize(
    ("say", "want"),
    [
        ("The ADS was engaged in autonomous mode.", "engaged"),
        ("The driver disengaged L3 ADS.", "not-engaged"),
        ("He took manual control, then the ADS was engaged in autonomous mode.", "engaged"),
        ("Operating in autonomous mode it went on, later in manual mode.", "not-engaged"),
        ("Nothing was said.", None),
        (None, None),
    ],
)
def test_engagement_cue(spark, say, want):
    df = spark.createDataFrame([(say,)], "t string")
    assert df.select(evidence.engagement_cue(F.col("t"))["value"]).first()[0] == want


def test_hedges_have_topics_and_whole_words(spark):
    say = "word " * 30 + "The van may have moved. The rider alleged minor injuries, reportedly." + " tail" * 30
    got = spark.createDataFrame([(say,)], "t string").select(evidence.hedges(F.col("t")).alias("h")).first()["h"]
    assert [h.topic for h in got] == ["mechanism", "injury", "other"]
    assert all(h.phrase in h.text and set(h.text.split()) <= set(say.split()) for h in got)


def test_consolidation_order_ties_and_versions(spark):
    rows = [
        dict(src_ord=1, report_version="2", city="A", narrative="first of two"),
        dict(src_ord=2, report_version="2", city="B"),
        dict(src_ord=3, report_version="10", report_id="r2", city="C", generation="historical", engagement_status="Verified Engaged"),
        dict(src_ord=4, report_version="9", report_id="r2", city="D", generation="historical"),
        dict(src_ord=5, report_version="draft", report_id="r3"),
        dict(src_ord=6, report_type="No New or Updated Incident Reports", report_id="r4"),
        dict(src_ord=7, report_id="r5", same_incident_id="  ", city=" "),
    ]
    got = {r.candidate_id: r for r in drafts(spark, *rows).collect()}
    assert set(got) == {"same-incident:i1", "singleton:current:r5"}
    c = got["same-incident:i1"]
    assert [k.report_id for k in c.report_keys] == ["r2", "r1"]  # historical comes first
    assert c.city is None and "city (C / A)" in c.curator_note
    assert c.automation_engagement is None and got["singleton:current:r5"].city is None


def test_order_and_partitions_do_not_matter(spark):
    rows = [row(src_ord=i, report_id=f"r{i % 7}", report_version=str(i % 3), city=f"c{i % 4}", same_incident_id=f"i{i % 3}") for i in range(60)]
    a = pipelines.build_incidents(spark.createDataFrame(rows, RAW))
    b = pipelines.build_incidents(spark.createDataFrame(rows[::-1], RAW).repartition(7))
    key = lambda df: sorted(map(str, df.select("candidate_id", "curator_note", "city", "report_keys").collect()))
    assert key(a) == key(b)


def test_representative_text_prefers_the_event(spark):
    filing = "Acme is submitting a duplicate report solely to avoid doubt under the Standing General Order." * 3
    event = "The vehicle was stopped in its lane when a truck made contact."
    got = drafts(spark, dict(narrative=filing), dict(src_ord=2, report_id="r2", narrative=event)).first()
    assert got.narrative == event


def test_causation_order_and_downgrades(spark):
    rear = "A truck struck the rear of the AV."
    cases = {
        "plain": (dict(narrative=rear), None, ("other-party-contributed", "well-supported")),
        "disputed": (dict(narrative=rear, cp_movement="x"), dict(narrative=rear, cp_movement="y"), ("other-party-contributed", "contested")),
        "occupant": (dict(narrative=rear + " A passenger opened the rear left door."), None, ("undetermined", "contested")),
        "animal": (dict(narrative=rear, crash_with="Animal"), None, ("undetermined", "well-supported")),
        "standing": (dict(sv_movement="Parked", cp_movement="Backing"), None, ("other-party-contributed", "well-supported")),
        "engaged": (dict(narrative="The AV hit a pole.", crash_with=None, engagement_status="Verified Engaged"), None, ("automation-system-contributed", "well-supported")),
        "human": (dict(narrative="The operator took over. The AV hit a pole.", crash_with=None, engagement_status="Verified Engaged"), None, ("undetermined", "contested")),
    }
    rows = []
    for i, (name, (a, b, _)) in enumerate(cases.items()):
        rows.append(dict(src_ord=10 * i, report_id=f"{name}-a", same_incident_id=name, **a))
        if b:
            rows.append(dict(src_ord=10 * i + 1, report_id=f"{name}-b", same_incident_id=name, **b))
    got = {r.same_incident_id: (r.causation_status.value, r.causation_status.confidence) for r in drafts(spark, *rows).collect()}
    assert got == {k: v[2] for k, v in cases.items()}


def test_names_and_places_resolve(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(evidence.resolve_name(v("Kodiak Robotics, Inc.", "Kodiak-Robotics Inc"))) == "Kodiak-Robotics Inc"
    assert pick(evidence.resolve_name(v("Acme", "Acme Robotics"))) is None
    assert pick(evidence.resolve_place(v("San Fancisco", "San Francisco"))) == "San Francisco"
    assert pick(evidence.resolve_place(v("San Fancisco", "San Jose"))) is None
    assert pick(evidence.resolve_place(v("St. Paul", "st paul"))) == "St. Paul" or pick(evidence.resolve_place(v("St. Paul", "st paul"))) == "st paul"


def test_plans_have_no_python(spark, sf):
    from faultline.plans import fixtures

    plan = fixtures.drafts(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
    assert isinstance(classify.classify, object) and consolidate.MIRRORED


def test_text_functions(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert pick(text.trim_or_null(lit("  x ﻿"))) == "x" and pick(text.trim_or_null(lit(" 　"))) is None
    for key, slug in (("same-incident:69dbcb440688427", "e897f33e"), ("same-incident:d9ef2eb5a3957bb", "2156118b"), ("singleton:historical:33175-9303", "228aeadf")):
        assert pick(text.hash_slug("nhtsa-", lit(key))) == f"nhtsa-{slug}"
    assert pick(text.normalize_url(lit("HTTPS://www.A.example/x/?q#f"))) == "a.example/x"
    assert pick(text.slug_base(lit("The FSD's Café — Über test"))) == "fsd-cafe-uber-test"
    long = "A first clause that is long enough here: and then a second part that runs on and on beyond the limit of it"
    assert pick(text.slug_from_title(lit(long))["method"]) == "clause-cut"
    assert pick(text.slug_from_title(lit(long))["slug"]) == "first-clause-that-is-long-enough-here"
    cut = pick(text.slug_from_title(lit("word " * 30))["slug"])
    assert len(cut) <= 80 and cut.endswith("word")
    assert pick(text.split_external_id(lit("a:b:c"))[1]) == "b:c"
    got = pick(dates.parse_month_year(lit("may-2024")))
    assert (str(got.date), got.precision, got.malformed) == ("2024-05-01", "month", False)
    assert pick(dates.parse_month_year(lit("SOON"))).malformed and not pick(dates.parse_month_year(lit(" "))).malformed


def test_texts_are_trimmed_of_white_space_alone(spark):
    cases = {w + "a" + w + "b" + w: "a" + w + "b" for w in text.WHITE} | {text.WHITE: None, "": None, "\u0085 a \u0085": "\u0085 a \u0085", "é漢": "é漢"}
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", text.trim_or_null(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in got} == cases


def test_positions_of_cues_are_sought_only_where_both_occur(spark):
    on, off = "The Level 4 ADS was engaged.", "The ADS was not engaged."
    rows = spark.createDataFrame([(f"{on}\n{off}",), (f"{off}\n{on}",), (on,), (off,), ("nothing",), (None,)], "t string")
    cue = rows.select(evidence.engagement_cue(F.col("t"))["value"].alias("v"))
    assert [r["v"] for r in cue.collect()] == ["not-engaged", "engaged", "engaged", "not-engaged", None, None]
    # What Spark would compute before the conditions, for every text, are the expressions that are asked twice outside branches of their own.
    conditions = cue._jdf.queryExecution().optimizedPlan().toString().split(" WHEN ")
    assert not any("AND" in c.split(" THEN ")[0] and "regexp_extract" in c.split(" THEN ")[0] for c in conditions)


def test_long_methods_are_cut_up(spark, sf):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    before = spark.conf.get(entry.HUGE_METHODS)
    try:
        spark.conf.set(entry.HUGE_METHODS, "65535")
        entry.queries()["f1_placeholders"](spark, sf)
        assert int(spark.conf.get(entry.HUGE_METHODS)) <= 8000
    finally:
        spark.conf.set(entry.HUGE_METHODS, before)


def test_patterns_are_tried_only_where_they_can_match(spark):
    groups = [R.ENGAGED, R.NOT_ENGAGED, *R.HEDGES.values(), R.CONTACT_VERBS, *(f[4] for f in evidence.FLAGS if f[4]), *((p,) for p in consolidate.FILING_PHRASES)]
    said = [t for t in fixtures.NARRATIVES if t] + ["", "  ", "THE KDS WAS NOT ENGAGED", "İN MANUAL MODE, Straße. IN MANUAL MODE", None]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for g in groups:
        assert text.needed_texts(tuple(g))
        found = F.coalesce(F.regexp_like("t", F.lit(text.any_of(tuple(g)))), F.lit(False))
        assert rows.filter(~found.eqNullSafe(text.matches(F.col("t"), tuple(g)))).count() == 0
    marked = evidence.marked_reports(rows.withColumnRenamed("t", "narrative"))
    plan = marked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(lower" in plan and "lambdafunction" not in plan  # what a lambda holds is interpreted


def test_conflicts_are_those_of_the_reports(spark, sf):
    c = fixtures.candidates(spark, sf)
    # The disagreements say all of it, so the reports are not read again.
    said, read = (evidence.field_evidence(c.drop(x)).select("candidate_id", "conflicts", "shape_conflicts", "inconsistent") for x in ("reports", "disagreements"))
    assert said.filter("size(conflicts) > 1").count() > 0
    assert said.exceptAll(read).count() == 0 == read.exceptAll(said).count()
