"""Evidence from the texts and fields of a candidate and its reports.

Flags stay wide, one column for each rule, for the classification; the long
table of atoms is made only where it is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, context_snippet, first_match, fold_name, fold_text, last_start, matches, present, sentences, where_needed
from . import rules_data as R
from .consolidate import DISAGREEMENT, MIRRORED, distinct_in_order


def engagement_cue(text: Column) -> Column:
    """struct(value, text): engaged or not-engaged as a narrative says it; of both, the one said last; null if none.

    The quoted text is the first pattern, in the order of the list, that
    occurs. Equal positions settle nothing.
    """
    on, off = matches(text, R.ENGAGED), matches(text, R.NOT_ENGAGED)
    last_on, last_off = last_start(text, R.ENGAGED), last_start(text, R.NOT_ENGAGED)
    cue = lambda v, p: F.struct(F.lit(v).alias("value"), first_match(text, p).alias("text"))
    engaged, idle = cue("engaged", R.ENGAGED), cue("not-engaged", R.NOT_ENGAGED)
    # Positions stand in a branch of their own: Spark reads both sides of an "and" for what is asked twice, and would look for them in every text.
    both = F.when(last_on > last_off, engaged).when(last_off > last_on, idle)
    return F.when(on & off, both).when(on, engaged).when(off, idle)


def hedges(text: Column) -> Column:
    """array of struct(topic, phrase, text): one for each topic whose patterns occur."""

    none = F.array().cast("array<struct<topic:string,phrase:string,text:string>>")

    def one(topic: str, patterns: tuple[str, ...]) -> Column:
        # The first pattern of the list that occurs is the one quoted.
        quoted = none
        for p in reversed(patterns):
            found = F.struct(
                F.lit(topic).alias("topic"),
                F.regexp_extract(text, f"(?i){p}", 0).alias("phrase"),
                context_snippet(text, p).alias("text"),
            )
            quoted = F.when(matches(text, (p,)), F.array(found)).otherwise(quoted)
        return quoted

    # Joined arrays are compiled; what a lambda filters would be interpreted, patterns and all.
    return F.concat(*(one(t, p) for t, p in R.HEDGES.items()))


def marked_reports(reports: DataFrame) -> DataFrame:
    """Reports with ``cue`` and ``hedges`` read from their narratives, before they are grouped: plain columns, one pass."""
    t = F.col("narrative")
    return reports.withColumns({"cue": engagement_cue(t), "hedges": hedges(t)})


def report_cues(candidates: DataFrame) -> DataFrame:
    """Adds ``cues`` and ``hedge_list``, read from every contributing report, each with its report's key.

    Reports that ``marked_reports`` has seen are not read again.
    """
    marked = {"cue", "hedges"} <= set(candidates.schema["reports"].dataType.elementType.names)
    keyed = lambda r: (r["reporting_generation"].alias("generation"), r["report_id"].alias("report_id"))
    said = F.col("reports")
    if not marked:
        kept = lambda r: (r["reporting_generation"].alias("reporting_generation"), r["report_id"].alias("report_id"))
        said = F.transform(
            said, lambda r: F.struct(*kept(r), engagement_cue(r["narrative"]).alias("cue"), hedges(r["narrative"]).alias("hedges"))
        )
    out = candidates.withColumn("_said", said)
    cues = F.transform(
        F.filter("_said", lambda x: x["cue"].isNotNull()),
        lambda x: F.struct(*keyed(x), x["cue"]["value"].alias("value"), x["cue"]["text"].alias("text")),
    )
    flat = F.flatten(
        F.transform(
            F.filter("_said", lambda x: F.size(x["hedges"]) > 0),
            lambda x: F.transform(
                x["hedges"],
                lambda h: F.struct(*keyed(x), h["topic"].alias("topic"), h["phrase"].alias("phrase"), h["text"].alias("text")),
            ),
        )
    )
    return out.withColumns({"cues": cues, "hedge_list": flat}).drop("_said")


def narrative_flags(df: DataFrame) -> DataFrame:
    """Adds one boolean for each rule over the representative narrative; false without a narrative.

    Two selects, so that the patterns do not all land in one generated method.
    """
    t, counterpart = F.col("narrative"), F.col("crash_interaction_counterpart")
    contacts = where_needed(t, R.CONTACT_VERBS, F.regexp_count(t, F.lit(any_of(R.CONTACT_VERBS))), F.lit(0))
    alone = counterpart.isNull() | counterpart.isin(*R.NO_OTHER_PARTY)
    first = df.withColumns(
        {
            "contact_phrases": contacts,
            "multi_contact": contacts >= R.MULTI_CONTACT,
            "no_contact": matches(t, R.NO_CONTACT),
            "rear_ended": matches(t, R.REAR_END),
            "emergency_response": matches(t, R.EMERGENCY),
            "handled_well": matches(t, R.BRAKED_TO_STOP) & matches(t, R.STOPPED_CONTACT),
            "not_struck": matches(t, R.NOT_DAMAGED) & matches(t, R.DAMAGE) & matches(t, R.TWO_OTHERS),
            "infrastructure": matches(t, R.INFRASTRUCTURE) & alone & ~matches(t, R.OTHER_ACTOR),
            "traffic_violation": matches(t, R.TRAFFIC_VIOLATION),
            "lane_intrusion": matches(t, R.LANE_INTRUSION),
            "automation_first": matches(t, R.AUTOMATION_FIRST),
        }
    )
    said = lambda phrase: F.get(F.filter(sentences(t), lambda s: F.contains(s, phrase)), F.lit(0))
    control, occupant = first_match(t, R.HUMAN_CONTROL), first_match(t, R.OCCUPANT)
    second = first.withColumns({"_control": control, "_occupant": occupant})
    second = second.withColumns({f"_{c[1]}said": F.when(F.col(c).isNotNull(), said(F.col(c))) for c in ("_control", "_occupant")})
    mark = F.regexp_instr(F.col("_csaid"), F.lit(f"(?i){R.AFTER_CONTACT}"))
    late = F.coalesce((mark > 0) & (mark < F.instr(F.col("_csaid"), F.col("_control"))), F.lit(False))
    other = matches(F.coalesce("_osaid", t), (R.OTHER_OWNER,))
    return second.withColumns(
        {
            "human_first": F.col("_control").isNotNull() & ~late,
            "human_untimed": F.col("_control").isNotNull() & late,
            "occupant_action": F.col("_occupant").isNotNull() & ~other,
        }
    ).drop("_control", "_occupant", "_csaid", "_osaid")


#: Flag, field of its atom, value, tier, and the patterns whose match is quoted.
FLAGS = (
    ("multi_contact", "multi_actor_chain_reaction_narrative", "true", "DERIVED", None),
    ("no_contact", "no_contact_occurred_narrative", "true", "EVIDENCE", R.NO_CONTACT),
    ("rear_ended", "contact_mechanism_narrative", "other-party-rear-ended-subject", "EVIDENCE", R.REAR_END),
    ("emergency_response", "active_emergency_response_narrative", "true", "EVIDENCE", R.EMERGENCY),
    ("handled_well", "successful_handling_pattern_narrative", "true", "EVIDENCE", R.BRAKED_TO_STOP),
    ("not_struck", "av_not_struck_third_party_collision_narrative", "true", "EVIDENCE", R.DAMAGE),
    ("infrastructure", "single_vehicle_infrastructure_contact_narrative", "true", "EVIDENCE", R.INFRASTRUCTURE),
    ("traffic_violation", "other_party_traffic_violation_narrative", "true", "EVIDENCE", R.TRAFFIC_VIOLATION),
    ("lane_intrusion", "other_party_lane_intrusion_narrative", "true", "EVIDENCE", R.LANE_INTRUSION),
    ("automation_first", "automation_action_before_handoff_narrative", "true", "EVIDENCE", R.AUTOMATION_FIRST),
    ("human_first", "human_took_control_before_contact_narrative", "true", "EVIDENCE", R.HUMAN_CONTROL),
    ("human_untimed", "human_took_control_timing_unknown_narrative", "true", "EVIDENCE", R.HUMAN_CONTROL),
    ("occupant_action", "subject_occupant_action_narrative", "true", "EVIDENCE", R.OCCUPANT),
)


def shortest(values: Column) -> Column:
    """The shortest of an array of texts, then the first in order."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]


def one_fold(values: Column, fold) -> Column:
    return F.size(F.array_distinct(F.transform(values, fold))) == 1


def resolve_name(values: Column) -> Column:
    """The name that several spellings stand for, when case, points, commas, hyphens and spaces are all that differ."""
    return F.when((F.size(values) > 1) & one_fold(values, fold_name), shortest(values))


def resolve_place(values: Column) -> Column:
    """The place that exactly two spellings stand for: cosmetic variants, or an approved respelling of one as the other."""
    two = F.size(values) == 2
    approved = F.lit(None).cast("string")
    for wrong, right in R.APPROVED_SPELLINGS.items():
        as_wrong = F.transform(values, lambda v: F.trim(F.lower(v)))
        as_right = F.transform(values, fold_text)
        hit = F.array_contains(as_wrong, wrong) & F.array_contains(as_right, right.lower())
        approved = F.when(hit, F.lit(right)).otherwise(approved)
    return F.when(two & one_fold(values, fold_text), shortest(values)).when(two, approved)


def field_evidence(df: DataFrame) -> DataFrame:
    """Adds checked conflicts, the inconsistency signal, resolved names and the location precision."""

    def conflict(c: str) -> tuple[Column, Column]:
        values = distinct_in_order(F.col("reports"), MIRRORED[c])
        return F.col(c).isNull() & (F.size(values) > 1), F.struct(F.lit(c).alias("field"), values.alias("values"))

    def told(d: Column) -> Column:
        """A disagreement under the candidate's name of the field; null if the field is not checked or has a value."""
        name = F.lit(None).cast("string")
        for c in R.CHECKED_FIELDS:
            name = F.when((d["field"] == MIRRORED[c]) & F.col(c).isNull(), F.lit(c)).otherwise(name)
        return F.struct(name.alias("field"), d["values"].alias("values"))

    if "disagreements" in df.columns:  # in the order of MIRRORED, which is that of CHECKED_FIELDS
        conflicts = F.filter(F.transform("disagreements", told), lambda x: x["field"].isNotNull())
    else:
        conflicts = present(DISAGREEMENT, *(conflict(c) for c in R.CHECKED_FIELDS))
    out = df.withColumn("conflicts", conflicts)
    of = lambda f: F.get(F.filter("conflicts", lambda d: d["field"] == f), F.lit(0))["values"]
    shape = F.transform(
        F.filter("conflicts", lambda d: d["field"].isin(*R.SHAPE_FIELDS)), lambda d: d["field"]
    )
    # Each is sought once, as a column, for all that is asked of it.
    out = out.withColumns({"shape_conflicts": shape, "_names": of("developer_or_operator"), "_cities": of("city")})
    resolved = {"developer_canonical": resolve_name(F.col("_names")), "city_canonical": resolve_place(F.col("_cities"))}
    out = out.withColumns(resolved).drop("_names", "_cities")
    precision = (
        F.when(F.coalesce("city_canonical", "city").isNotNull(), "city")
        .when(F.col("state").isNotNull(), "region")
        .when(F.col("country_code").isNotNull(), "country")
        .otherwise("unknown")
    )
    return out.withColumns({"inconsistent": F.size("shape_conflicts") >= 2, "location_precision": precision})


def extract_evidence(candidates: DataFrame) -> DataFrame:
    """Candidates with all evidence as columns: narrow work on each row, no shuffle."""
    return field_evidence(narrative_flags(report_cues(candidates)))


ATOM = "tier, field, value, topic, source_type, generation, report_id, text, rule"


def _atom(tier, field, value, text, source="narrative", generation=None, report=None, topic=None, rule=None) -> Column:
    c = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    parts = (tier, field, value, topic, source, generation, report, text, rule)
    return F.struct(*(c(p).alias(n) for p, n in zip(parts, ATOM.split(", "))))


def atoms(evidence: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Long table (candidate_id, ord, tier, field, value, topic, source_type, generation, report_id, text, rule).

    Of ``only``, the atoms of these fields alone: no others are made, and the
    evidence computes only what these need. ``ord`` numbers the atoms made.
    """
    several = F.size("reports") > 1
    lone = F.get("reports", F.lit(0))
    one = lambda f: F.when(~several, lone[f])
    asked = lambda f: only is None or f in only
    source = F.when(several, "consolidated").otherwise("structured")
    at = dict(generation=one("reporting_generation"), report=one("report_id"))
    made = []
    for f in R.CANDIDATE_FIELDS:
        if asked(f"candidate.{f}"):
            kind = F.lit("narrative") if f == "narrative" else source
            made.append((F.col(f).isNotNull(), _atom("EVIDENCE", f"candidate.{f}", F.col(f), F.col(f), kind, **at)))
    t = F.col("narrative")
    for flag, field, value, tier, patterns in FLAGS:
        if asked(field):
            text = F.coalesce(first_match(t, patterns), F.substring(t, 1, 80)) if patterns else F.col("contact_phrases")
            rule, kind = (None, "narrative") if patterns else ("multi-actor-chain-reaction-detector", "rule")
            made.append((F.col(flag), _atom(tier, field, value, text, kind, rule=rule, **at)))
    shape = F.when(F.col("inconsistent"), F.array_join("shape_conflicts", ", ")) if asked("source_record_inconsistency") else None
    derived = (
        ("source_record_inconsistency", shape, "source-record-inconsistency-multi-field"),
        ("developer_or_operator_canonical", F.col("developer_canonical"), "developer-alias-table"),
        ("city_canonical", F.col("city_canonical"), "cosmetic-or-approved-mapping-resolution"),
        ("location_precision", F.col("location_precision"), "location-precision-ladder"),
    )
    made += [(c.isNotNull(), _atom("DERIVED", f, c, c, "rule", rule=rule)) for f, c, rule in derived if asked(f)]
    parts = [present(f"struct<{', '.join(f'{n}:string' for n in ATOM.split(', '))}>", *made)] if made else []
    wanted = [f for f in R.REPORT_FIELDS if asked(f)]
    if wanted:
        of = lambda r, f: _atom("EVIDENCE", f, r[f], r[f], "structured", r["reporting_generation"], r["report_id"])
        each = lambda r: F.filter(F.array(*(F.when(r[f].isNotNull(), of(r, f)) for f in wanted)), lambda a: a.isNotNull())
        parts.append(F.flatten(F.transform("reports", each)))
    if asked("automation_engagement_narrative"):
        cue = lambda c: _atom("EVIDENCE", "automation_engagement_narrative", c["value"], c["text"], "narrative", c["generation"], c["report_id"])
        parts.append(F.transform("cues", cue))
    if asked("narrative_hedge"):
        hedge = lambda h: _atom("EVIDENCE", "narrative_hedge", h["phrase"], h["text"], "narrative", h["generation"], h["report_id"], h["topic"])
        parts.append(F.transform("hedge_list", hedge))
    if not parts:
        raise ValueError(f"no atoms have the fields {only}")
    long = evidence.select("candidate_id", F.posexplode(F.concat(*parts)).alias("ord", "a"))
    return long.select("candidate_id", "ord", "a.*")
