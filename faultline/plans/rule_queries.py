"""Queries of evidence from a rule table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, consolidate, evidence, rule_table
from ..operators import rules_data as R
from . import fixtures, oracles, pipelines
from .oracles import CANDIDATES, FLAGGED, T, any_of, quoted, text, w
from .queries import FLAGS, joined, labels

#: Rules that a user adds to the table: (name, patterns of each part with their sign).
USER_RULES = {
    "turned": (((r"\bleft turn\b", r"\bright turn\b"), 1),),
    "braked_without_stop": (((r"\bbraked\b",), 1), ((r"\bcame to a stop\b", r"\bstopped\b"), -1)),
    "twice_av": (((r"\bav\b",), 1),),
}


def user_rows() -> list[tuple]:
    rows = []
    for name, parts in USER_RULES.items():
        for i, (patterns, sign) in enumerate(parts):
            rows += rule_table.rows_of(name, patterns, part=i, sign=sign, least=2 if name == "twice_av" else 1)
    return rows


def read(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of written reports, with the evidence of the default rules.

    The texts and the rows come from one shuffle of the reports by candidate,
    which evidence and candidates are joined on as they lie.
    """
    return rule_table.with_rule_evidence(consolidate.build_candidates(fixtures.reports(spark, sf)), rule_table.rule_table(spark))


def said(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Evidence of one kind in the narratives of reports; these are never grouped, so no other field of a report is read."""
    reports = pipelines.latest_reports(fixtures.raw_reports(spark, sf), "reporting_generation", "report_id", "same_incident_id", "narrative")
    return rule_table.text_evidence(rule_table.report_texts(reports), rule_table.rule_table(spark).filter(F.col("kind") == kind))


def e3_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf).select("candidate_id", *FLAGS)


def e1_rule_cues(spark: SparkSession, sf: str) -> DataFrame:
    e = said(spark, sf, "cue").filter(F.col("cue").isNotNull())
    return e.select("candidate_id", "ord.report_id", "cue.value", "cue.text")


def e2_rule_hedges(spark: SparkSession, sf: str) -> DataFrame:
    e = said(spark, sf, "hedge").select("candidate_id", "ord.report_id", F.explode("hedges").alias("h"))
    return e.select("candidate_id", "report_id", "h.topic", "h.phrase", "h.text")


def e_user_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = rule_table.rule_table(spark, user_rows())
    found = rule_table.rule_evidence(fixtures.candidates(spark, sf), rules)
    own = F.filter("flags", lambda f: f.isin(*USER_RULES))
    return found.filter(F.size(own) > 0).select("candidate_id", joined(own, ",").alias("rules"))


def c_rule_table(spark: SparkSession, sf: str) -> DataFrame:
    return labels(classify.classify(evidence.field_evidence(read(spark, sf))))


QUERIES = {f.__name__: f for f in (e3_rule_table, e1_rule_cues, e2_rule_hedges, e_user_rules, c_rule_table)}


def _user(name: str) -> str:
    if name == "twice_av":
        return f"len(regexp_extract_all({T}, '(?i)\\bav\\b')) >= 2"
    return " AND ".join(("" if sign > 0 else "NOT ") + any_of(T, patterns) for patterns, sign in USER_RULES[name])


def snippet(phrase: str, pad: int = 60) -> str:
    """The phrase with up to ``pad`` characters on either side, widened to whole words."""
    at = f"strpos({T}, {phrase})"
    start, end = f"greatest({at} - {pad}, 1)", f"({at} + length({phrase}) + {pad})"
    return (
        f"trim(concat(regexp_extract(substr({T}, 1, {start} - 1), '\\S*$'), substr({T}, {start}, {end} - {start}), regexp_extract(substr({T}, {end}), '^\\S*')))"
    )


ORACLE = {
    "e3_rule_table": oracles.ORACLE["e3_narrative_flags"],
    "e1_rule_cues": oracles.ORACLE["e1_engagement_cues"],
    "e2_rule_hedges": w(
        CANDIDATES,
        " UNION ALL ".join(
            f"SELECT candidate_id, report_id, {text(t)} AS topic, {quoted(T, p)} AS phrase, {snippet(quoted(T, p))} AS text FROM ordered WHERE {quoted(T, p)} IS NOT NULL"
            for t, p in R.HEDGES.items()
        ),
    ),
    "e_user_rules": w(
        FLAGGED,
        "SELECT candidate_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_user(n)} THEN {text(n)} END" for n in sorted(USER_RULES)) + ") AS rules FROM cand WHERE "
        + " OR ".join(f"({_user(n)})" for n in USER_RULES),
    ),
    "c_rule_table": oracles.ORACLE["c_classify"],
}
