"""Ordered rules from evidence flags to labels.

Each label is a struct of value, basis (the rule that gave it), justification
and confidence. The first rule that holds wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches
from .rules_data import AVOIDANCE, FIELD_NAMES

# Labels by the text of the engagement field.
ENGAGEMENT = {
    "Verified Engaged": "driving-automation-engaged-confirmed",
    "Verified Not Engaged": "driving-automation-not-engaged",
    "Alleged Engaged": "driving-automation-engaged-reported",
    "Unknown - see Narrative": "driving-automation-status-uncertain",
}
ACTIVE_MOVES = ("Changing Lanes", "Making Left Turn", "Making Right Turn", "Backing")
WELL, CONTESTED = "well-supported", "contested"


def label(value, basis: str, why, confidence: str | None) -> Column:
    c = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(
        c(value).alias("value"), F.lit(basis).alias("basis"), c(why).alias("justification"), c(confidence).alias("confidence")
    )


def chain(*rules: tuple[Column, Column], default: Column) -> Column:
    out = default
    for condition, result in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), result).otherwise(out)
    return out


def automation_status(df: DataFrame) -> DataFrame:
    """From the engagement field (the candidate's, else the first report's that has one), else from narratives."""
    field = F.coalesce(
        F.col("automation_engagement"),
        F.get(F.filter(F.transform("reports", lambda r: r["automation_engagement_text"]), lambda v: v.isNotNull()), F.lit(0)),
    )
    mapped = None
    for text, value in ENGAGEMENT.items():
        mapped = F.when(field == text, F.lit(value)) if mapped is None else mapped.when(field == text, F.lit(value))
    said = F.array_distinct(F.transform("cues", lambda c: c["value"]))
    first = F.get("cues", F.lit(0))["text"]
    quoted = F.concat(F.lit('A narrative says: "'), first, F.lit('".'))
    status = chain(
        (mapped.isNotNull(), label(mapped, "field", F.concat(F.lit("Structured Engagement Status: "), field), WELL)),
        ((F.size(said) == 1) & (F.get(said, F.lit(0)) == "engaged"), label(ENGAGEMENT["Verified Engaged"], "narrative", quoted, WELL)),
        (F.size(said) == 1, label(ENGAGEMENT["Verified Not Engaged"], "narrative", quoted, WELL)),
        (F.size(said) > 1, label(ENGAGEMENT["Unknown - see Narrative"], "narratives-differ", "Narratives differ on engagement.", CONTESTED)),
        default=label("unknown", "none", "Neither the field nor a narrative states engagement.", WELL),
    )
    return df.withColumn("automation_status", status)


def contribution_supported() -> Column:
    """Whether automation may be said to have contributed: engaged with no human before it, or acting before a handoff."""
    engaged = F.col("automation_status.value").isin(ENGAGEMENT["Verified Engaged"], ENGAGEMENT["Alleged Engaged"])
    return (engaged & ~F.col("human_first")) | F.col("automation_first")


def causation_status(df: DataFrame) -> DataFrame:
    """Twelve ordered rules, then two downgrades: a disputed field first, then an occupant's action."""
    subject, other = F.col("subject_vehicle_precrash_movement"), F.col("other_actor_precrash_movement")
    und, theirs = "undetermined", "other-party-contributed"
    hedge = F.get(F.filter("hedge_list", lambda h: h["topic"].isin("mechanism", "other")), F.lit(0))["text"]
    raw = chain(
        (F.col("not_struck"), label(und, "not-struck", "Others collided; the subject was not struck.", WELL)),
        (F.col("multi_contact"), label(und, "multi-contact", "Several contacts are described; no single actor follows.", CONTESTED)),
        (
            F.col("infrastructure") & contribution_supported(),
            label("automation-system-contributed", "infrastructure", "No other party; the automated manoeuvre made the contact.", WELL),
        ),
        (F.col("infrastructure"), label(und, "infrastructure", "No other party, and automation is not shown to have acted.", CONTESTED)),
        (F.col("crash_interaction_counterpart") == "Animal", label(und, "animal", "The counterpart is an animal.", WELL)),
        (F.col("rear_ended"), label(theirs, "rear-end", "The other party struck the subject from behind.", WELL)),
        (F.col("traffic_violation"), label(theirs, "traffic-violation", "The other party passed a red light or signal.", WELL)),
        (F.col("lane_intrusion"), label(theirs, "lane-intrusion", "The other party entered the subject's lane.", WELL)),
        (F.col("occupant_action"), label(und, "occupant", "An occupant's own action mattered to the contact.", CONTESTED)),
        (
            subject.isin("Stopped", "Parked") & other.isNotNull(),
            label(theirs, "standing", F.concat(F.lit("Subject was "), F.lower(subject), F.lit("; other party: "), other), WELL),
        ),
        (
            subject.isin(*ACTIVE_MOVES) & (F.col("automation_status.value") == ENGAGEMENT["Verified Not Engaged"]),
            label(und, "manual-manoeuvre", F.concat(F.lit("Subject was "), F.lower(subject), F.lit(" under manual control.")), CONTESTED),
        ),
        (hedge.isNotNull(), label(und, "hedge", F.concat(F.lit('The source is unsure: "'), hedge, F.lit('".')), CONTESTED)),
        default=label(und, "default", "Nothing supports a closer category.", CONTESTED),
    )
    out = df.withColumn("_raw", raw)
    disputed = F.exists("conflicts", lambda d: d["field"].isin("subject_vehicle_precrash_movement", "other_actor_precrash_movement", "crash_interaction_counterpart"))
    confidence = F.when(disputed & (F.col("_raw.confidence") == WELL), F.lit(CONTESTED)).otherwise(F.col("_raw.confidence"))
    conflict = (F.col("_raw.value") == theirs) & F.col("occupant_action")
    final = F.when(
        conflict, label(und, "occupant-conflict", "A contact mechanism and an occupant's action are both described.", CONTESTED)
    ).otherwise(
        F.struct(
            F.col("_raw.value").alias("value"),
            F.col("_raw.basis").alias("basis"),
            F.col("_raw.justification").alias("justification"),
            confidence.alias("confidence"),
        )
    )
    return out.withColumn("causation_status", final).drop("_raw")


def event_type(df: DataFrame) -> DataFrame:
    counterpart = F.col("crash_interaction_counterpart")
    responder = counterpart == "First Responder Vehicle"
    unexpected = "unexpected-or-inappropriate-behaviour"
    return df.withColumn(
        "event_type",
        chain(
            (F.col("not_struck"), label("traffic-disruption-or-obstruction", "not-struck", "Braking led others to collide.", WELL)),
            (F.col("infrastructure") & F.col("human_first"), label(unexpected, "infrastructure-human", "Contact with infrastructure after a human took control.", WELL)),
            (F.col("infrastructure"), label(unexpected, "infrastructure", "Contact with infrastructure, no other party.", WELL)),
            (counterpart == "Animal", label("other", "animal", "An animal strike has no type of its own.", WELL)),
            (F.regexp_like(counterpart, F.lit("(?i)^Non-Motorist")), label("vulnerable-road-user-interaction", "road-user", F.concat(F.lit("Counterpart: "), counterpart), WELL)),
            (responder & F.col("emergency_response"), label("emergency-vehicle-interaction", "emergency", "A first responder in active response.", WELL)),
            (F.col("no_contact"), label("other", "no-contact", "The source says there was no contact.", WELL)),
            (responder, label("collision", "responder", "A first responder, not in active response.", WELL)),
            default=label("collision", "default", "A reported crash without a closer type.", WELL),
        ),
    )


def valence(df: DataFrame) -> DataFrame:
    neutral, failure = "neutral-or-unclear", "failure-or-challenging"
    return df.withColumn(
        "valence",
        chain(
            (F.col("not_struck"), label(neutral, "not-struck", "The subject braked; others collided.", WELL)),
            (F.col("infrastructure") & F.col("human_first"), label(failure, "infrastructure-human", "Contact with infrastructure after a human took control.", WELL)),
            (F.col("infrastructure"), label(failure, "infrastructure", "Contact with infrastructure, no other party.", WELL)),
            (F.col("crash_interaction_counterpart") == "Animal", label(neutral, "animal", "An animal strike is neutral by rule.", WELL)),
            (F.col("handled_well"), label("successful-handling", "handled", "The subject had stopped before it was struck.", WELL)),
            default=label(neutral, "default", "Neither handling nor failure is shown.", CONTESTED),
        ),
    )


def scenario_tags(df: DataFrame) -> DataFrame:
    """Distinct tags of all rules that hold, with a tier; no tags is UNSUPPORTED."""
    counterpart, kind = F.col("crash_interaction_counterpart"), F.col("event_type.value")
    def tags(condition: Column, *names: str) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.coalesce(condition, F.lit(False)), F.array(*(F.lit(n) for n in names))).otherwise(none)

    animal = counterpart == "Animal"
    road_user = kind == "vulnerable-road-user-interaction"
    off = F.exists("cues", lambda c: c["value"] == "not-engaged") | (F.coalesce(F.col("automation_engagement") == "Verified Not Engaged", F.lit(False)))
    found = F.array_distinct(
        F.concat(
            tags(F.col("not_struck"), "debris-avoidance-braking", "third-party-chain-collision", "av-not-physically-involved"),
            tags(F.col("infrastructure"), "single-vehicle-infrastructure-contact", "parking-lot-maneuver", "no-other-party"),
            tags(animal, "animal-strike"),
            tags(animal & (F.col("handled_well") | matches(F.col("narrative"), AVOIDANCE)), "attempted-avoidance-maneuver"),
            tags(road_user & F.regexp_like(counterpart, F.lit("(?i)Cyclist")), "cyclist-interaction"),
            tags(road_user & F.regexp_like(counterpart, F.lit("(?i)Pedestrian")), "pedestrian-interaction"),
            tags((counterpart == "First Responder Vehicle") & (kind == "collision"), "police-vehicle"),
            tags(F.col("rear_ended"), "struck-from-behind"),
            tags(off, "autonomy-disengaged-before-impact"),
        )
    )
    some = F.size(found) > 0
    return df.withColumn(
        "scenario_tags",
        F.struct(
            F.when(some, found).alias("value"),
            F.when(some, "CLASSIFICATION").otherwise("UNSUPPORTED").alias("tier"),
            F.when(some, WELL).alias("confidence"),
        ),
    )


def inconsistency_text(n: Column, fields: Column) -> Column:
    return F.concat(
        F.lit("There is a source-record inconsistency: the reports of this incident differ in "),
        n.cast("string"),
        F.lit(" fields that shape the event ("),
        fields,
        F.lit("). Which account holds, and whether it is one event, stays open."),
    )


def unknowns(df: DataFrame) -> DataFrame:
    """Sentences for what the reports leave open; a conflict that a resolved name settles is not one."""
    name = F.col
    open_ = F.filter(
        "conflicts",
        lambda d: ~((d["field"] == "developer_or_operator") & name("developer_canonical").isNotNull())
        & ~((d["field"] == "city") & name("city_canonical").isNotNull()),
    )

    def named(f: Column) -> Column:
        for a, b in FIELD_NAMES.items():
            f = F.when(f == a, F.lit(b)).otherwise(f)
        return F.replace(f, F.lit("_"), F.lit(" "))

    said = F.transform(
        open_,
        lambda d: F.concat(
            F.lit("The reports give several values of "),
            named(d["field"]),
            F.lit(": "),
            F.array_join(d["values"], " / "),
            F.lit("; which one holds is for a curator to say."),
        ),
    )
    more = F.when(
        name("inconsistent"), F.array(inconsistency_text(F.size("shape_conflicts"), F.array_join("shape_conflicts", ", ")))
    ).otherwise(F.array().cast("array<string>"))
    return df.withColumn("unknowns", F.concat(said, more))


def classify(evidence: DataFrame) -> DataFrame:
    """Evidence with automation_status, causation_status, event_type, valence, scenario_tags and unknowns."""
    out = evidence
    for step in (automation_status, causation_status, event_type, valence, scenario_tags, unknowns):
        out = step(out)
    return out
