"""Data-quality checks: each is a rule, a predicate that says a row fails it, and a message.

All checks give one long table (key, rule, message). A batch is valid when
the table is empty; valid rows are those that it does not name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import PRECISIONS, legal_pair
from ..functions.text import matches, present, trim_or_null
from .events import EVENT_TYPE_LABELS
from .rules_data import FIELD_NAMES, NO_OTHER_PARTY

# Closed vocabularies.
VOCABULARIES: dict[str, tuple[str, ...]] = {
    "event_type": tuple(EVENT_TYPE_LABELS),
    "valence": ("failure-or-challenging", "successful-handling", "neutral-or-unclear"),
    "automation_status": (
        "driving-automation-engaged-confirmed",
        "driving-automation-engaged-reported",
        "driving-automation-status-uncertain",
        "driving-automation-not-engaged",
        "unknown",
    ),
    "causation_status": (
        "undetermined",
        "automation-system-contributed",
        "other-party-contributed",
        "shared-or-multiple-factors",
        "not-applicable",
    ),
    "location_precision": ("exact-point", "road-or-intersection", "local-area", "city", "region", "country", "unknown"),
}
TOO_FINE = ("exact-point", "road-or-intersection", "local-area")
NEVER_IN_DRAFTS = ("system_version", "system_name")
NEVER_PUBLIC_IN_DRAFTS = ("is_public", "first_published_at", "event_source", "reviewStatus")
DECISIONS = ("import", "rejected", "deferred", "manual-review")
MEDIA = ("video", "image", "article", "none", "unknown")


@dataclass
class Check:
    rule: str
    fails: Column
    message: Column | str


def with_violations(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``df`` with ``violations``: an array of (rule, message) of the checks that a row fails; a null predicate does not fail."""
    found = [
        (
            c.fails,
            F.struct(
                F.lit(c.rule).alias("rule"),
                (F.lit(c.message) if isinstance(c.message, str) else F.coalesce(c.message, F.lit(c.rule))).alias("message"),
            ),
        )
        for c in checks
    ]
    return df.withColumn("violations", present("struct<rule:string,message:string>", *found))


def exploded(checked: DataFrame, key: str) -> DataFrame:
    """(key, rule, message) of rows with ``violations``."""
    # Exploding an expression, not the column: Spark infers a filter from a column and copies all rules below.
    each = F.explode(F.filter("violations", lambda x: x.isNotNull()))
    long = checked.select(F.col(key).cast("string").alias("key"), each.alias("v"))
    return long.select("key", "v.*")


def sound(checked: DataFrame) -> DataFrame:
    """Rows whose ``violations`` are empty, without that column.

    A generator of one row or none drops the others: a filter would be pushed
    below the labels and copy their rules into itself many times over.
    """
    one = F.explode(F.when(F.size("violations") == 0, F.array(F.lit(True))))
    return checked.select("*", one.alias("_sound")).drop("_sound", "violations")


def violations(df: DataFrame, key: str, checks: list[Check]) -> DataFrame:
    """(key, rule, message): the failing checks of each row."""
    return exploded(with_violations(df, checks), key)


def said(text: str, *cols: Column) -> Column:
    return F.concat(F.lit(text), F.concat_ws(", ", *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols)))


def valid(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Rows that no violation names."""
    return df.join(found.select(F.col("key").alias(key)), key, "left_anti")


def not_in(column: str, vocabulary: tuple[str, ...], rule: str, nullable: bool = True) -> Check:
    c = F.col(column)
    outside = ~c.isin(*vocabulary)
    return Check(rule, outside if nullable else F.coalesce(outside, F.lit(True)), said(f"{column} is not in its vocabulary: ", c))


def reject_unknown_enum(df: DataFrame, key: str, column: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose value a vocabulary table (value) lacks; for vocabularies too long for a list."""
    misses = df.filter(F.col(column).isNotNull()).join(vocabulary.select(F.col("value").alias(column)), column, "left_anti")
    return misses.select(
        F.col(key).cast("string").alias("key"), F.lit(f"enum:{column}").alias("rule"), said(f"{column}: ", F.col(column)).alias("message")
    )


def duplicate_keys(df: DataFrame, key: str, member: str, rule: str = "duplicate") -> DataFrame:
    """(key, rule, message, members): keys that several rows hold, with how many; null keys are none.

    Counts are combined before the shuffle; members of a key are counted, and
    the smallest and largest are named, so a hot key stays one row.
    """
    held = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key"))
    out = held.agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.col(member).cast("string")).alias("least"),
        F.max(F.col(member).cast("string")).alias("most"),
    )
    return out.filter("members > 1").select(
        "key", F.lit(rule).alias("rule"), said("held by ", F.col("least"), F.col("most")).alias("message"), "members"
    )


def unique_rows(df: DataFrame, columns: list[str], member: str, rule: str = "duplicate", where: Column | str | None = None, nulls_distinct: bool = False) -> DataFrame:
    """(key, rule, message, members): combinations of ``columns`` that several rows hold, among the rows of ``where``.

    As a unique index does, only rows for which ``where`` is true count. Nulls
    are equal to each other, as in NULLS NOT DISTINCT, unless
    ``nulls_distinct``. The key is the columns' values as JSON, nulls
    included, so no text can pass for another combination; counts are combined
    before the shuffle.
    """
    rows = df if where is None else df.filter(where)
    if nulls_distinct:
        rows = rows.dropna(subset=columns)
    key = F.to_json(F.array(*(F.col(c).cast("string") for c in columns)), {"ignoreNullFields": "false"})
    held = rows.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("members"), F.min(F.col(member).cast("string")).alias("least"), F.max(F.col(member).cast("string")).alias("most")
    )
    return held.filter("members > 1").select(
        "key", F.lit(rule).alias("rule"), said("held by ", F.col("least"), F.col("most")).alias("message"), "members"
    )


def missing_references(df: DataFrame, key: str, column: str, target: DataFrame, target_key: str, rule: str) -> DataFrame:
    """Rows whose reference resolves to no target row."""
    known = target.select(F.col(target_key).alias(column)).distinct()
    lost = df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
    return lost.select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), said(f"{column} not found: ", F.col(column)).alias("message"))


def draft_checks(columns: list[str]) -> list[Check]:
    """Rules over classified candidates: vocabularies, precision, use of evidence, and attribution that evidence bears out.

    ``_unknowns`` are the sentences of ``unknowns`` as lower-case lines.
    """
    c = F.col
    label = {f: c(f"{f}.value") for f in ("event_type", "valence", "automation_status", "causation_status")}
    basis = {f: c(f"{f}.basis") for f in label}
    why = {f: c(f"{f}.justification") for f in label}
    contributed = label["causation_status"] == "automation-system-contributed"
    engaged = label["automation_status"].isin("driving-automation-engaged-confirmed", "driving-automation-engaged-reported")

    def named(f: Column) -> Column:
        for a, b in FIELD_NAMES.items():
            f = F.when(f == a, F.lit(b)).otherwise(f)
        return F.replace(f, F.lit("_"), F.lit(" "))

    open_ = F.filter(
        "conflicts",
        lambda d: ~((d["field"] == "developer_or_operator") & c("developer_canonical").isNotNull())
        & ~((d["field"] == "city") & c("city_canonical").isNotNull())
        & ~F.contains(c("_unknowns"), named(d["field"])),
    )
    outside = [
        Check(f"1-2:{f}", ~label[f].isin(*VOCABULARIES[f]), said(f"{f} is not in its vocabulary: ", label[f])) for f in label
    ]
    off_topic = F.filter(
        "hedge_list", lambda h: h["topic"].isin("injury", "administrative") & F.contains(why["causation_status"], h["text"])
    )
    own = r"automat\w+[^.]{0,40}(own|itself|its own)\s+man(oeuv|euv)er|automated man(oeuvre|euver)"
    checks = [
        *outside,
        Check("1-2:location_precision", ~c("location_precision").isin(*VOCABULARIES["location_precision"]), said("location_precision: ", c("location_precision"))),
        Check("3", c("location_precision").isin(*TOO_FINE), said("finer than the source allows: ", c("location_precision"))),
        Check("7", contributed & matches(why["causation_status"], (r"perceiv", r"planning failure", r"failed to detect", r"sensor fault", r"misjudg")), "a mechanism is asserted"),
        Check("8", F.size(open_) > 0, F.concat(F.lit("not in unknowns: "), F.array_join(F.transform(open_, lambda d: d["field"]), ", "))),
        Check("10", (F.size("cues") > 0) & (label["automation_status"] == "unknown"), "narrative cues were not used"),
        Check("11", c("automation_engagement").isNotNull() & (basis["automation_status"] != "field"), "the engagement field was not the basis"),
        Check("20", contributed & ~((engaged & ~c("human_first")) | c("automation_first")), "automation's part is not supported"),
        Check(
            "21",
            (basis["event_type"].startswith("infrastructure") | basis["valence"].startswith("infrastructure"))
            & c("crash_interaction_counterpart").isNotNull()
            & ~c("crash_interaction_counterpart").isin(*NO_OTHER_PARTY),
            said("a concrete other party: ", c("crash_interaction_counterpart")),
        ),
        Check("22", (label["causation_status"] == "other-party-contributed") & c("occupant_action"), "an occupant's action conflicts"),
        Check("23", F.size(off_topic) > 0, "a hedge about something else is cited"),
        Check("24", c("inconsistent") & ~F.exists("unknowns", lambda u: matches(u, (r"source.record inconsistency",))), "inconsistency is not in unknowns"),
        *(
            Check("25", c("human_first") & matches(why[f], (own,)), f"{f} attributes the manoeuvre to automation")
            for f in ("event_type", "valence")
        ),
    ]
    for rule, names in (("4", NEVER_IN_DRAFTS), ("12-13", NEVER_PUBLIC_IN_DRAFTS)):
        checks += [Check(rule, F.lit(True), f"drafts carry no {n}") for n in names if n in columns]
    return checks


def with_draft_violations(drafts: DataFrame) -> DataFrame:
    """Drafts with what they fail as ``violations``."""
    lines = F.lower(F.array_join("unknowns", "\n"))  # once for each draft, and not again for each conflict and sentence
    return with_violations(drafts.withColumn("_unknowns", lines), draft_checks(drafts.columns)).drop("_unknowns")


def validate_drafts(drafts: DataFrame) -> DataFrame:
    """(key, rule, message) of all drafts that fail a rule."""
    return exploded(with_draft_violations(drafts), "candidate_id")


def hedges_carried(evidence: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rule 9: hedges of the evidence that the atom table lacks."""
    want = evidence.select("candidate_id", F.explode("hedge_list").alias("h")).select("candidate_id", F.col("h.phrase").alias("value"))
    have = atoms.filter("field = 'narrative_hedge'").select("candidate_id", "value").distinct()
    lost = want.join(have, ["candidate_id", "value"], "left_anti")
    return lost.select(F.col("candidate_id").alias("key"), F.lit("9").alias("rule"), said("hedge lost: ", F.col("value")).alias("message"))


EXTERNAL_ID = r"(?s)^(historical|current):.+$"


def event_checks() -> list[Check]:
    """Structural checks of generated events."""
    c = F.col
    filled = lambda *cols: F.coalesce(*(c(x) for x in cols)).isNotNull()
    vocab = [not_in(f, VOCABULARIES[f], f"enum:{f}", nullable=False) for f in VOCABULARIES]
    return [
        Check("public", ~c("is_public").eqNullSafe(False), "is_public is not false"),
        *vocab,
        Check("too-fine", c("location_precision").isin(*TOO_FINE), said("location_precision: ", c("location_precision"))),
        Check("occurred-on", ~legal_pair(c("occurred_on"), c("occurred_on_precision")), "date and precision do not fit"),
        Check("curator-field", filled("title", "summary", "interpretation", "review_status"), "a curator's field is set"),
        Check("observed-facts", F.coalesce(F.size("observed_facts") != 0, F.lit(True)), "observed_facts is not an empty array"),
        Check("system-field", filled("system_name", "system_version") | ~c("system_version_knowledge").eqNullSafe("unknown"), "a system field is set"),
    ]


def source_checks() -> list[Check]:
    c = F.col
    return [
        Check("external-id", ~F.coalesce(F.regexp_like("external_record_id", F.lit(EXTERNAL_ID)), F.lit(False)), said("external_record_id: ", c("external_record_id"))),
        Check("published-on", ~legal_pair(c("published_on"), c("published_on_precision")), "date and precision do not fit"),
        Check("source-type", ~c("source_type").eqNullSafe("regulatory-record"), said("source_type: ", c("source_type"))),
    ]


#: Marks of what a batch holds, beside its violations.
EVENTS, NO_URL = "#events", "#null-urls"
MARK = "struct<rule: string, key: string, detail: string, nth: long, event: long, source: long>"


def structural_marks(events: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, key, detail, n, events, sources): one scan of events and of sources, one shuffle, for all structural checks.

    Each row says all that the checks need of it in one array: the row checks
    it fails (numbered, so they stay apart), the keys that have to be unique
    or referred to, and what is to be counted. Marks are counted by rule and
    key with a partial step before the shuffle, so a key that many rows hold
    sends one row from each task. Counters are marks too, so they are right
    when tasks run again.
    """
    c = F.col

    def mark(rule, key, detail=None, event=0, source=0, nth=None) -> Column:
        longs = (F.lit(None) if nth is None else nth, F.lit(event), F.lit(source))
        parts = (F.lit(rule) if isinstance(rule, str) else rule, key, F.lit(None) if detail is None else detail)
        return F.struct(*(x.cast("string") for x in parts), *(x.cast("long") for x in longs)).cast(MARK)

    def marks(df: DataFrame, checks: list[Check], key: str, *more: Column) -> DataFrame:
        checked = with_violations(df, checks).withColumn("_nth", F.monotonically_increasing_id())
        failed = F.transform("violations", lambda v: mark(v["rule"], c(key), v["message"], nth=c("_nth")))
        kept = F.filter(F.array(*more), lambda m: m.isNotNull())
        return checked.select(F.explode(F.concat(failed, kept)).alias("m")).select("m.*")

    unique = lambda rule, key: F.when(c(key).isNotNull(), mark(rule, c(key)))
    e = marks(
        events,
        event_checks(),
        "slug",
        unique("duplicate-candidate", "candidate_id"),
        unique("duplicate-slug", "slug"),
        mark("no-source", c("slug"), event=1),
        mark(EVENTS, F.lit(None)),
    )
    s = marks(
        sources,
        source_checks(),
        "event_slug",
        mark("duplicate-external-id", c("event_slug"), c("external_record_id")),
        F.when(c("event_slug").isNotNull(), mark("no-source", c("event_slug"), source=1)),
        F.when(c("url").isNull(), mark(NO_URL, F.lit(None))),
    )
    keys = ["rule", "key", "detail", "nth"]
    out = e.unionByName(s).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.sum("source").alias("sources")
    )
    return out.drop("nth")


def _violated() -> Column:
    """Whether a mark of :func:`structural_marks` is a violation."""
    r = F.col("rule")
    several = r.isin("duplicate-candidate", "duplicate-slug", "duplicate-external-id")
    return (
        F.when(r == "no-source", (F.col("events") > 0) & (F.col("sources") == 0))
        .when(r.startswith("#"), F.lit(False))
        .otherwise(~several | (F.col("n") > 1))
    )


def marked_violations(marks: DataFrame) -> DataFrame:
    """(key, rule, message) of the marks that are violations."""
    message = (
        F.when(F.col("rule") == "no-source", F.lit("no source"))
        .when(F.col("n") > 1, F.concat_ws(": ", F.concat(F.lit("rows that hold it: "), F.col("n").cast("string")), F.col("detail")))
        .otherwise(F.col("detail"))
    )
    return marks.filter(_violated()).select("key", "rule", message.alias("message"))


def structural_qa(events: DataFrame, sources: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """All structural violations of a batch of events and sources: rows, unique keys, at least one source, unknowns carried over."""
    found = marked_violations(structural_marks(events, sources))
    if drafts is not None:
        both = events.select("candidate_id", "slug", "unknowns").join(drafts.select("candidate_id", F.col("unknowns").alias("drafted")), "candidate_id")
        found = found.unionByName(violations(both, "slug", [Check("unknowns", ~F.col("unknowns").eqNullSafe(F.col("drafted")), "unknowns differ from the draft's")]))
    return found


QA_RULES = (
    "duplicate-candidate", "duplicate-slug", "public", "enum", "too-fine", "occurred-on", "published-on", "curator-field",
    "observed-facts", "system-field", "external-id", "duplicate-external-id", "no-source", "unknowns", "source-type",
)


def qa_counters(marks: DataFrame, processed: int | None = None, invalid: int = 0, more: DataFrame | None = None) -> DataFrame:
    """One row from :func:`structural_marks`: a counter and a passed flag for each rule, sources without a URL (a blocker, not a failure), and one event for each candidate.

    ``processed`` is the number of candidates (without it, that of the
    events); ``more`` holds violations found elsewhere. Nothing is scanned
    again: events and sources are counted by their marks.
    """
    tally = marks.select("rule", "n", _violated().alias("bad"))
    if more is not None:
        tally = tally.unionByName(more.select("rule", F.lit(1).cast("long").alias("n"), F.lit(True).alias("bad")))
    kind = F.substring_index("rule", ":", 1)
    name = lambda r: r.replace("-", "_")
    held = lambda r: F.coalesce(F.sum(F.when(F.col("rule") == r, F.col("n"))), F.lit(0))
    counts = tally.agg(
        *(F.count_if(F.col("bad") & (kind == r)).alias(f"n_{name(r)}") for r in QA_RULES), held(EVENTS).alias("generated"), held(NO_URL).alias("null_urls")
    )
    flags = {f"ok_{name(r)}": F.col(f"n_{name(r)}") == 0 for r in QA_RULES}
    done = F.col("generated") if processed is None else F.lit(processed).cast("long")
    return counts.withColumns(
        flags
        | {
            "processed": done,
            "ok_one_event_each": F.col("generated") + invalid == done,
            "ok_no_invalid_draft": F.lit(invalid == 0),
        }
    )


def publication_checks() -> list[Check]:
    """Checks of linked export rows (candidate and event columns, event_exists, sources array)."""
    c = F.col
    there = c("event_exists")
    blank = lambda x: F.nullif(c(x), F.lit("")).isNull()
    bare = F.exists("sources", lambda s: (s["source_type"] == "regulatory-record") & F.nullif(s["external_record_id"], F.lit("")).isNull())
    checks = [
        Check("no-link", c("linked_event_id").isNull(), "no linked event"),
        Check("no-event", ~there, "the linked event does not exist"),
        Check("origin", there & ~c("origin").eqNullSafe("source-derived"), said("origin: ", c("origin"))),
        Check("public", there & ~c("is_public").eqNullSafe(False), "is_public is not false"),
        *(Check(f"set:{x}", there & c(x).isNotNull(), f"{x} is set") for x in ("title", "summary", "review_status")),
        Check("observed-facts", there & F.coalesce(F.size("observed_facts") != 0, F.lit(True)), "observed_facts is not empty"),
        *(Check(f"null:{x}", there & blank(x), f"{x} is missing") for x in ("developer_or_operator", "event_type", "valence")),
        Check("type-label", there & ~c("event_type").isin(*EVENT_TYPE_LABELS), said("no label for ", c("event_type"))),
        Check("no-source", there & F.coalesce(F.size("sources") < 1, F.lit(True)), "no source"),
        Check("source-id", there & bare, "a regulatory source lacks its record id"),
        Check("status", ~c("candidate_status").eqNullSafe("pending"), said("status: ", c("candidate_status"))),
    ]
    return checks


def publication_preconditions(linked: DataFrame) -> DataFrame:
    """Violations of linked export rows, and of the batch: an event that several candidates link."""
    found = violations(linked, "candidate_id", publication_checks())
    several = linked.filter("linked_event_id is not null").groupBy("linked_event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    batch = linked.join(several, "linked_event_id").select(
        F.col("candidate_id").alias("key"), F.lit("multiple-links").alias("rule"), said("linked by several: ", F.col("linked_event_id")).alias("message")
    )
    return found.unionByName(batch)


def manifest_checks() -> list[Check]:
    """Checks of curated manifest records with nested ``sources``."""
    c = F.col
    imports, blank = c("decision") == "import", lambda x: trim_or_null(c(x)).isNull()
    video = F.exists("sources", lambda s: s["is_event_video"] & (s["media_kind"] == "video"))
    known = F.array(*(F.lit(m) for m in MEDIA))
    return [
        Check("decision", F.coalesce(~c("decision").isin(*DECISIONS), F.lit(True)), said("decision: ", c("decision"))),
        Check("decision-reason", blank("decision_reason"), "no reason"),
        Check("legacy-title", blank("legacy_title"), "no title"),
        Check("event-video", imports & ~F.coalesce(video, F.lit(False)), "no source shows the event"),
        Check("review", imports & ~c("review_status").eqNullSafe("curator-reviewed"), said("review_status: ", c("review_status"))),
        *(Check(f"enum:{f}", imports & F.coalesce(~c(f).isin(*VOCABULARIES[f]), F.lit(True)), said(f"{f}: ", c(f))) for f in ("event_type", "valence", "automation_status", "causation_status")),
        Check("confirmed", imports & (c("automation_status") == "driving-automation-engaged-confirmed") & ~c("collection").eqNullSafe("first-hand"), "confirmed, but not first-hand"),
        Check("date-pair", imports & ~legal_pair(c("event_date"), c("event_date_precision")), "date and precision do not fit"),
        Check("country", imports & ~F.regexp_like("location_country_code", F.lit("^[A-Z]{2}$")), said("country: ", c("location_country_code"))),
        *(Check(f"empty:{x}", imports & F.coalesce(F.size(x) < 1, F.lit(True)), f"{x} is empty") for x in ("observable_evidence", "unknowns")),
        *(Check(f"blank:{x}", imports & blank(x), f"{x} is blank") for x in ("summary", "proposed_title")),
        Check("source-url", F.exists("sources", lambda s: ~F.coalesce(F.regexp_like(s["source_url"], F.lit("^https?://")), F.lit(False))), "a source has no http(s) URL"),
        Check("media-kind", F.exists("sources", lambda s: F.coalesce(~F.array_contains(known, s["media_kind"]), F.lit(True))), "a source's media kind is not known"),
        Check("import-only", ~imports & c("review_status").eqNullSafe("curator-reviewed"), "reviewed, but not imported"),
        Check("rejected-video", (c("decision") == "rejected") & F.exists("sources", lambda s: s["is_event_video"]), "rejected, but a source shows the event"),
        Check("unique-of", (c("duplicate_status") == "unique") & c("duplicate_of").isNotNull(), "unique, but a duplicate of something"),
        Check("duplicate-of", (c("duplicate_status") != "unique") & c("duplicate_of").isNull(), "a duplicate of nothing"),
        Check("duplicate-import", imports & (c("duplicate_status") == "exact-duplicate"), "an exact duplicate is imported"),
    ]


def manifest_violations(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Row checks, unique ids, media ids in one record only, and references to records or existing slugs."""
    found = violations(records, "legacy_id", manifest_checks())
    found = found.unionByName(duplicate_keys(records, "legacy_id", "legacy_title", "duplicate-id").drop("members"))
    media = records.select("legacy_id", F.explode("sources").alias("s")).select("legacy_id", F.col("s.media_id").alias("media_id"))
    found = found.unionByName(duplicate_keys(media, "media_id", "legacy_id", "duplicate-media").drop("members"))
    targets = records.select(F.col("legacy_id").alias("k")).unionByName(existing.select(F.col("slug").alias("k")))
    refs = records.filter("duplicate_status <> 'unique'")
    return found.unionByName(missing_references(refs, "legacy_id", "duplicate_of", targets, "k", "unresolved-duplicate"))


def row_constraints() -> list[Check]:
    """Constraints of stored events as expectations."""
    c = F.col
    blank = lambda x: c(x).isNotNull() & trim_or_null(c(x)).isNull()
    return [
        Check("slug", F.coalesce(~F.regexp_like("slug", F.lit("^[a-z0-9]+(-[a-z0-9]+)*$")), F.lit(True)), said("slug: ", c("slug"))),
        *(Check(f"blank:{x}", blank(x), f"{x} is blank") for x in ("title", "summary", "developer_or_operator", "location_text")),
        *(not_in(f, VOCABULARIES[f], f"enum:{f}") for f in VOCABULARIES),
        not_in("occurred_on_precision", PRECISIONS, "enum:occurred_on_precision", nullable=False),
        Check("date-pair", ~legal_pair(c("occurred_on"), c("occurred_on_precision")), "date and precision do not fit"),
        Check("country", ~F.regexp_like("location_country_code", F.lit("^[A-Z]{2}$")), said("country: ", c("location_country_code"))),
    ]


def lookup_constraints() -> list[Check]:
    c = F.col
    shape = (
        ((c("level") == "country") & c("region_code").isNull() & c("city_name").isNull())
        | ((c("level") == "region") & c("region_code").isNotNull() & c("city_name").isNull())
        | ((c("level") == "city") & c("city_name").isNotNull())
    )
    return [
        Check("level-shape", ~F.coalesce(shape, F.lit(False)), said("level: ", c("level"))),
        Check("latitude", ~c("latitude").between(-90, 90), said("latitude: ", c("latitude"))),
        Check("longitude", ~c("longitude").between(-180, 180), said("longitude: ", c("longitude"))),
        Check("display-name", trim_or_null(c("display_name")).isNull(), "no display name"),
    ]


#: Fields that a public event must have, by origin.
REQUIRED = {
    "source-derived": ("title", "developer_or_operator", "event_type", "valence"),
    "curated": ("title", "developer_or_operator", "event_type", "valence", "summary", "review_status", "observed_facts"),
}


def completeness(events: DataFrame, sources: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """(slug, origin, missing): public events that lack a required field or any source."""
    kinds = dict(events.dtypes)
    lacks = lambda x: F.coalesce(F.size(x) < 1, F.lit(True)) if kinds[x].startswith("array") else F.col(x).isNull()
    have = sources.select(F.col("event_slug").alias("slug"), F.lit(True).alias("sourced")).distinct()
    e = events.filter("is_public").join(have, "slug", "left")
    gaps = [F.when((F.col("origin") == o) & lacks(x), F.lit(x)) for o, xs in required.items() for x in xs]
    gaps.append(F.when(F.col("sourced").isNull(), F.lit("sources")))
    missing = F.filter(F.array(*gaps), lambda x: x.isNotNull())
    return e.select("slug", "origin", missing.alias("missing")).filter(F.size("missing") > 0)


def corpus_invariants(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Violations that no single row shows: a slug held twice, no source, no date of update."""
    bare = events.join(sources.select(F.col("event_slug").alias("slug")), "slug", "left_anti")
    return (
        duplicate_keys(events, "slug", "slug", "duplicate-slug").drop("members")
        .unionByName(violations(bare, "slug", [Check("no-source", F.lit(True), "no source")]))
        .unionByName(violations(events, "slug", [Check("no-update", F.col("record_updated").isNull(), "no date of update")]))
    )


def count_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, actual, expected) of counts (name, n) that differ, or that one side lacks."""
    a, e = (df.select("name", F.col("n").alias(k)) for df, k in ((actual, "actual"), (expected, "expected")))
    both = a.join(e, "name", "full_outer")
    return both.filter(~F.col("actual").eqNullSafe(F.col("expected"))).select("name", "actual", "expected")


def assert_counts(actual: dict[str, int], expected: dict[str, int]) -> None:
    """Raise when a count differs from the approved one."""
    off = {k: (actual.get(k), v) for k, v in expected.items() if actual.get(k) != v}
    if off:
        raise ValueError(f"counts differ from the approved ones (actual, expected): {off}")


def snapshot_transitions(
    before: DataFrame, after: DataFrame, sources: tuple[DataFrame, DataFrame] | None = None, submissions: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Violations between two snapshots, one keyed pass over all tables.

    Events (id, slug, title, is_public, first_published_at): frozen slugs and
    publish times, new rows private, no rename while publishing. Sources
    (before, after; event_slug): an event that is public keeps a source.
    Submissions (id, status, reviewed_at): a review stamp comes only with a
    move off pending, and a move off pending has one; reviewed ones do not go
    back. Every row of every snapshot becomes one slim row, and all of them
    meet in a single shuffle by table and key; sources are counted before it.
    """
    c = F.col
    fields = ("slug", "is_public", "first_published_at", "title", "status", "reviewed_at")
    kinds = dict.fromkeys(fields, "string") | {"is_public": "boolean", "first_published_at": "timestamp", "reviewed_at": "timestamp"}

    def side(df: DataFrame, table: str, key: str, old: bool, *have: str, n: Column | None = None) -> DataFrame:
        row = F.struct(*((c(x) if x in have else F.lit(None)).cast(kinds[x]).alias(x) for x in fields))
        none = F.lit(None).cast(row_type)
        return df.select(
            F.lit(table).alias("table"),
            c(key).cast("string").alias("key"),
            (row if old else none).alias("old"),
            (none if old else row).alias("new"),
            (F.lit(0) if n is None else n).cast("long").alias("n"),
        )

    row_type = "struct<" + ", ".join(f"{x}: {kinds[x]}" for x in fields) + ">"
    kept = ("slug", "is_public", "first_published_at", "title")
    parts = [side(before, "event", "id", True, *kept), side(after, "event", "id", False, *kept)]
    if sources is not None:
        # By slug: public events, and how many sources each has in the later snapshot; an earlier one shows what was lost.
        parts.append(side(after.filter("is_public"), "source", "slug", False, "slug", "is_public"))
        for df, old in zip(sources, (True, False)):
            counts = df.groupBy("event_slug").agg(F.count(F.lit(1)).alias("held"))
            parts.append(side(counts, "source", "event_slug", True, n=c("held") * (1 << 40 if old else 1)))
    if submissions is not None:
        parts += [side(df, "submission", "id", old, "status", "reviewed_at") for df, old in zip(submissions, (True, False))]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    both = rows.groupBy("table", "key").agg(F.max("old").alias("old"), F.max("new").alias("new"), F.sum("n").alias("n"))
    old, new = (lambda x: c("old")[x]), (lambda x: c("new")[x])
    is_event, is_source, is_sub = (c("table") == t for t in ("event", "source", "submission"))
    there = c("old").isNotNull() & c("new").isNotNull()
    published = old("first_published_at").isNotNull()
    frozen, stamped = is_event & there & published, is_sub & new("reviewed_at").isNotNull()
    pending = lambda s: s.eqNullSafe("pending")
    checks = [
        Check("frozen-slug", frozen & ~new("slug").eqNullSafe(old("slug")), said("slug changed: ", old("slug"), new("slug"))),
        Check("frozen-publish-time", frozen & ~new("first_published_at").eqNullSafe(old("first_published_at")), "first publish time changed"),
        Check("created-public", is_event & c("old").isNull() & new("is_public"), "created public"),
        Check("renamed-on-publish", is_event & there & ~old("is_public") & new("is_public") & ~new("slug").eqNullSafe(old("slug")), "slug changed while publishing"),
        Check("unstamped", is_event & c("new").isNotNull() & new("is_public") & new("first_published_at").isNull(), "public without a publish time"),
        Check("deleted-public", is_event & c("new").isNull() & old("is_public"), "a public event is gone"),
        Check("last-source-lost", is_source & new("is_public") & (c("n") >= 1 << 40) & (c("n") % (1 << 40) == 0), "a public event lost its last source"),
        Check("public-without-source", is_source & new("is_public") & (c("n") == 0), "a public event has no source"),
        Check("stamped-while-pending", stamped & pending(new("status")), "a review stamp on a pending submission"),
        Check("unstamped-review", is_sub & there & pending(old("status")) & ~pending(new("status")) & new("reviewed_at").isNull(), "reviewed without a stamp"),
        Check("back-to-pending", is_sub & there & ~pending(old("status")) & pending(new("status")), "a reviewed submission is pending again"),
        Check("review-stamp-changed", is_sub & there & old("reviewed_at").isNotNull() & ~new("reviewed_at").eqNullSafe(old("reviewed_at")), "the review stamp changed"),
        Check("created-reviewed", is_sub & c("old").isNull() & ~pending(new("status")), "created reviewed"),
    ]
    return violations(both, "key", checks)


def submission_checks() -> list[Check]:
    c = F.col
    long = lambda x, n: F.length(c(x)) > n
    return [
        Check("url", F.coalesce(~F.regexp_like("evidence_url", F.lit(r"^https?://\S+$")), F.lit(True)), "no http(s) URL"),
        Check("url-length", long("evidence_url", 2000), "URL too long"),
        Check("text-length", long("what_happened", 5000), "text too long"),
        Check("email", ~F.regexp_like("submitter_email", F.lit(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")), "no e-mail address"),
        Check("date", c("event_date").isNotNull() & F.try_to_date(c("event_date"), "yyyy-MM-dd").isNull(), said("date: ", c("event_date"))),
    ]
