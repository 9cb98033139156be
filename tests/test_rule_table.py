"""Evidence rules as rows: required words, guards, user rules, and agreement with the fixed columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions.patterns import required_texts, required_words
from faultline.operators import evidence, rule_table
from faultline.operators import rules_data as R
from faultline.plans import fixtures

ALL = sorted({row[7][4:] for row in rule_table.default_rows()})


def words_of(text):
    return set(re.split(r"[^a-z0-9_]+", text.lower()))


def test_required_words_are_whole_words_of_every_alternative():
    assert required_words(r"\bmay have\b") == ["have"]
    assert required_words(r"took\s+manual\s+control") == ["manual"]  # the others may be parts of words
    assert required_words(r"\bcat\b|\bdogs\b") == ["cat", "dogs"]
    assert required_words(r"\bcat\b|dog") == [] and required_texts(r"\bcat\b|dog") == ["cat", "dog"]
    assert required_words(r"\bred (\w+\s+)?light\b") == ["light"]
    assert required_words(r"\b(a )?red\b") == ["red"] and required_words(r"\b(a)?red\b") == []
    assert required_words(r"colou?r") == [] and required_texts(r"[ab]+") == []


@pytest.mark.parametrize("pattern", ALL)
def test_matches_hold_what_is_required(pattern):
    """Texts mixed from the narratives' words: where a pattern occurs, what it requires is there."""
    rng = random.Random(pattern)
    vocabulary = [w for n in fixtures.NARRATIVES if n for w in n.split()] + re.findall(r"[a-z]{2,}", pattern)
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))
        if re.search(pattern, text, re.IGNORECASE):
            wanted, inside = required_words(pattern), required_texts(pattern)
            assert not wanted or words_of(text) & set(wanted)
            assert not inside or any(t in text.lower() for t in inside)


SCHEMA = (
    "candidate_id string, narrative string, crash_interaction_counterpart string, "
    "reports array<struct<reporting_generation: string, report_id: string, narrative: string>>"
)
TEXTS = [
    *fixtures.NARRATIVES,
    "",
    "Striking vehicles; THE AV STRUCK a curb, struck a pole and struck a gate.",
    "After the impact the driver took over. The operator took over.",
    "The driver took over.\nAfter the collision the teleoperator took control.",
    "A passenger in the other AV opened the front left door.",
    "The ADS was not engaged, then Level 4 ADS was engaged. ADS was not engaged.",
    "disengaged L4 ADS",
]


def candidates(spark):
    other = [None, "Other Fixed Object", "Passenger Car"]
    rows = [(f"c{i}", t, other[i % 3], [("current", f"r{i}", t), ("current", f"s{i}", TEXTS[i - 1])]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("most", [rule_table.BROADCAST_INDEX, 0])
def test_table_gives_the_rows_of_the_columns(spark, monkeypatch, most):
    monkeypatch.setattr(rule_table, "BROADCAST_INDEX", most)
    c = candidates(spark)
    columns = ["candidate_id", *(f[0] for f in evidence.FLAGS), "cues", "hedge_list"]
    want = evidence.narrative_flags(evidence.report_cues(c)).select(*columns).collect()
    got = rule_table.with_rule_evidence(c, rule_table.rule_table(spark)).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert rule_table.rule_evidence(c.limit(0), rule_table.rule_table(spark)).count() == 0


def test_reports_as_rows_give_the_same(spark):
    c = candidates(spark)
    rows = c.select("candidate_id", F.posexplode("reports").alias("ord", "r")).select("candidate_id", "ord", "r.narrative")
    rules = rule_table.rule_table(spark)
    a, b = rule_table.rule_evidence(c, rules), rule_table.rule_evidence(c, rules, rows)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_users_add_rules_as_rows(spark):
    mine = [
        *rule_table.rows_of("wet", (r"\brain\b", r"\bwet road\b")),
        *rule_table.rows_of("dry_stop", (r"\bstopped\b",)),
        *rule_table.rows_of("dry_stop", (r"\brain\b",), part=1, sign=-1),
        *rule_table.rows_of("two_cars", (r"\bcars?\b",), least=2),
    ]
    texts = ["It stopped in the rain.", "It stopped.", "A car met a car on a wet road", "Rainy: train", None]
    c = spark.createDataFrame([(str(i), t, None, []) for i, t in enumerate(texts)], SCHEMA)
    got = {r["candidate_id"]: r["flags"] for r in rule_table.rule_evidence(c, spark.createDataFrame(mine, rule_table.RULES)).collect()}
    assert got == {"0": ["wet"], "1": ["dry_stop"], "2": ["two_cars", "wet"]}
    deep = spark.createDataFrame(rule_table.rows_of("deep", ("a",), part=rule_table.MOST_PARTS), rule_table.RULES)
    with pytest.raises(ValueError, match="parts"):
        rule_table.rule_evidence(c, deep)


def test_only_rules_of_a_text_are_tried(spark):
    """The plan joins words with the index; regular expressions come after that join."""
    plan = rule_table.rule_matches(rule_table.texts_of(candidates(spark)), rule_table.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.index("RLIKE") < plan.index("BroadcastHashJoin")  # printed from the top: tried after the join
    assert R.MULTI_CONTACT == 3
