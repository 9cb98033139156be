"""Guarded merges: target and source in, new snapshot with an ``action`` column out.

Every merge can be repeated: a second run changes nothing. What must hold for
a whole batch is counted first and raised before anything is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_slug
from .versions import latest_version


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def any_differs(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x | y, (differs(a, b) for a, b in pairs), F.lit(False))


def merged(target: DataFrame, source: DataFrame, key: list[str], guard, update: list[str]) -> DataFrame:
    """Full outer join on ``key``: new keys are inserted, columns ``update`` are taken over where the guard allows.

    ``guard(t, s)`` gives the condition; t and s look a column up on either
    side. Rows that only the target has, and columns that are not updated,
    stay. The source has the target's columns, or lacks some, which insert as
    null.
    """
    cols = target.columns
    t = target.select(*key, *(F.col(c).alias(f"t_{c}") for c in cols if c not in key), F.lit(True).alias("t_"))
    own = [c for c in source.columns if c in cols and c not in key]
    s = source.select(*key, *(F.col(c).alias(f"s_{c}") for c in own), F.lit(True).alias("s_"))
    both = t.join(s, key, "full_outer")
    left, right = (lambda c: F.col(f"t_{c}")), (lambda c: F.col(f"s_{c}"))
    take = F.col("t_").isNotNull() & F.col("s_").isNotNull() & F.coalesce(guard(left, right), F.lit(False))
    new = F.col("t_").isNull()

    def value(c: str) -> Column:
        if c not in own:
            return left(c)
        return F.when(new | take, right(c)).otherwise(left(c)) if c in update else F.when(new, right(c)).otherwise(left(c))

    action = F.when(new, "insert").when(take, "update").otherwise("noop")
    return both.select(*(F.col(c) if c in key else value(c).alias(c) for c in cols), action.alias("action"))


REPORT_KEY = ["reporting_generation", "report_id"]
#: What the same version of a report may be refreshed for; the date of retrieval and the link are not among them.
REPORT_CONTENT = [
    "same_incident_id", "reporting_entity", "developer_or_operator", "incident_date", "incident_date_precision",
    "report_submission_date", "city", "state", "country_code", "automation_engagement_text",
    "crash_interaction_counterpart_text", "subject_vehicle_precrash_movement_text", "other_actor_precrash_movement_text",
    "injury_outcome_text", "narrative",
]


def merge_reports(target: DataFrame, source: DataFrame) -> DataFrame:
    """Newer versions always; the same version only if its content differs; an older one never. Links stay."""

    def guard(t, s):
        content = any_differs([(t(c), s(c)) for c in REPORT_CONTENT if c in target.columns and c in source.columns])
        return (s("report_version") > t("report_version")) | ((s("report_version") == t("report_version")) & content)

    update = [c for c in source.columns if c not in (*REPORT_KEY, "candidate_id")]
    return merged(target, source, REPORT_KEY, guard, update)


#: Candidate columns that a refresh may change, while nobody has looked at the candidate.
MECHANICAL = [
    "developer_or_operator", "automation_engagement", "incident_date", "incident_date_precision", "city", "state",
    "crash_interaction_counterpart", "subject_vehicle_precrash_movement", "other_actor_precrash_movement",
    "injury_outcome", "narrative", "curator_note",
]


def merge_candidates(target: DataFrame, source: DataFrame, key: str = "same_incident_id") -> DataFrame:
    """Candidates by incident id: inserted once, refreshed only while pending and different; human columns never."""
    update = [c for c in MECHANICAL if c in source.columns]
    guard = lambda t, s: (t("status") == "pending") & any_differs([(t(c), s(c)) for c in update])
    out = merged(target, source, [key], guard, update)
    frozen = (F.col("action") == "noop") & (F.col("status") != "pending")
    return out.withColumn("action", F.when(frozen, "frozen").otherwise(F.col("action")))


def merge_singletons(candidates: DataFrame, reports: DataFrame, source: DataFrame) -> DataFrame:
    """Candidates of reports without an incident id, keyed by the report's own link.

    ``reports`` has candidate_id as its link, null before the first run;
    ``source`` has the report's key and the candidate's columns. The id of a
    new candidate is a hash of its key, so a second run meets the first.
    """
    links = reports.select(*REPORT_KEY, F.col("candidate_id").alias("link"))
    keyed = source.drop("candidate_id").join(links, REPORT_KEY, "left")
    own = hash_slug("c-", F.concat_ws(":", F.lit("singleton"), *REPORT_KEY), 32)
    keyed = keyed.withColumn("candidate_id", F.coalesce("link", own)).drop("link", *REPORT_KEY)
    return merge_candidates(candidates, keyed, "candidate_id")


def link_reports(reports: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reports linked to the candidate of their incident; ``changed`` where the link was another or none."""
    c = candidates.filter("same_incident_id is not null").select("same_incident_id", F.col("candidate_id").alias("new_link"))
    out = reports.join(c, "same_incident_id", "left").withColumn("new_link", F.coalesce("new_link", "candidate_id"))
    out = out.withColumn("changed", differs(F.col("candidate_id"), F.col("new_link")))
    return out.withColumn("candidate_id", F.col("new_link")).drop("new_link")


def classify_writes(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(action, n): what importing ``new`` reports would do to ``existing`` ones."""
    e = existing.select(*REPORT_KEY, F.col("report_version").alias("have"))
    action = F.when(F.col("have").isNull(), "insert").when(F.col("have") != F.col("report_version"), "update").otherwise("noop")
    return new.join(e, REPORT_KEY, "left").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def classify_candidate_writes(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, action, n): grouped and singleton candidates to insert or reuse, by candidate id."""
    e = existing.select("candidate_id", F.lit(True).alias("have")).distinct()
    kind = F.when(F.col("same_incident_id").isNull(), "singleton").otherwise("grouped")
    action = F.when(F.col("have"), "reuse").otherwise("insert")
    return new.join(e, "candidate_id", "left").groupBy(kind.alias("kind"), action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, changed): rows of both snapshots in which some column differs, nulls equal, with the columns' names."""
    b = before.select(key, *(F.col(c).alias(f"b_{c}") for c in cols))
    both = b.join(after.select(key, *cols), key)
    names = F.filter(F.array(*(F.when(differs(F.col(c), F.col(f"b_{c}")), F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    return both.select(key, names.alias("changed")).filter(F.size("changed") > 0)


def unlike_rows(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keys of rows of both snapshots in which some column is written differently.

    Each row is joined as the SHA-256 of its columns, not whole. A row that
    this does not name is equal in all of them; of those that it names,
    :func:`snapshot_diff` says which columns differ.
    """
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    row = F.unhex(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", **micros}), 256))
    return before.select(key, row.alias("was")).join(after.select(key, row.alias("now")), key).filter(F.col("was") != F.col("now")).select(key)


def assert_set_equal(a: DataFrame, b: DataFrame) -> None:
    """Raise when the distinct rows of two frames differ."""
    if not (a.subtract(b).isEmpty() and b.subtract(a).isEmpty()):
        raise ValueError("the two sets differ")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, with ``side``."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def frozen_key_changes(before: DataFrame, now: DataFrame, key: str = "legacy_id", frozen: str = "slug") -> DataFrame:
    """Known ids whose frozen key changed or that are gone."""
    n = now.select(key, F.col(frozen).alias("now"), F.lit(True).alias("there"))
    both = before.select(key, F.col(frozen).alias("before")).join(n, key, "left")
    problem = F.when(F.col("there").isNull(), "dropped").when(differs(F.col("before"), F.col("now")), "changed")
    return both.select(key, "before", "now", problem.alias("problem")).filter("problem is not null")


def missing_expected(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Expected rows that are not attached."""
    return expected.select(*key).distinct().join(actual.select(*key), key, "left_anti")


def has_child(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def lacks_child(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def target_set_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of an explicit list of ids, and no others; an id that comes twice or that no row has is an error."""
    twice = ids.groupBy(key).count().filter("`count` > 1")
    lost = ids.select(key).join(df.select(key), key, "left_anti")
    if not (twice.isEmpty() and lost.isEmpty()):
        raise ValueError("the list has ids twice, or ids that no row has")
    return df.join(ids, key)


def promotion_states(candidates: DataFrame, events: DataFrame, sources: DataFrame, records: DataFrame) -> DataFrame:
    """Records (candidate_id, slug, expected sources) with ``state``: A linked and whole, B nothing there yet, C neither."""
    n = sources.groupBy(F.col("event_slug").alias("slug")).agg(F.count(F.lit(1)).alias("have_sources"))
    c = candidates.select("candidate_id", F.col("linked_event_id").alias("link"), F.lit(True).alias("candidate_there"))
    e = events.select("slug", F.lit(True).alias("event_there"))
    out = records.join(c, "candidate_id", "left").join(e, "slug", "left").join(n, "slug", "left").na.fill(0, ["have_sources"])
    whole = F.col("event_there") & F.col("link").eqNullSafe(F.col("slug")) & (F.col("have_sources") == F.col("expected_sources"))
    clean = F.col("candidate_there") & F.col("link").isNull() & F.col("event_there").isNull() & (F.col("have_sources") == 0)
    return out.withColumn("state", F.when(whole, "A").when(clean, "B").otherwise("C"))


def promote(candidates: DataFrame, events: DataFrame, sources: DataFrame, new_events: DataFrame, new_sources: DataFrame):
    """(candidates, events, sources) after promotion. Whole records are left alone, clean ones inserted; any other stops all."""
    expected = new_sources.groupBy(F.col("event_slug").alias("slug")).agg(F.count(F.lit(1)).alias("expected_sources"))
    records = new_events.select("candidate_id", "slug").join(expected, "slug", "left").na.fill(0, ["expected_sources"])
    states = promotion_states(candidates, events, sources, records)
    broken = states.filter("state = 'C'").count()
    if broken:
        raise ValueError(f"{broken} records are neither whole nor clean; nothing is promoted")
    clean = states.filter("state = 'B'").select("slug", "candidate_id")
    add = new_events.join(clean.select("slug"), "slug", "left_semi")
    add_sources = new_sources.join(clean.select(F.col("slug").alias("event_slug")), "event_slug", "left_semi")
    linked = candidates.join(clean.withColumnRenamed("slug", "new_link"), "candidate_id", "left")
    linked = linked.withColumn("linked_event_id", F.coalesce("linked_event_id", "new_link")).drop("new_link")
    union = lambda a, b: a.unionByName(b.select(*(c for c in b.columns if c in a.columns)), allowMissingColumns=True)
    return linked.select(*candidates.columns), union(events, add), union(sources, add_sources)


def promotion_problems(candidates: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """(problem, n): what must not hold after a promotion, with how often it does."""
    linked = candidates.filter("linked_event_id is not null").select(F.col("linked_event_id").alias("slug"))
    derived = events.filter("origin = 'source-derived'")
    several = linked.groupBy("slug").count().filter("`count` > 1")
    frames = {
        "link-without-event": linked.join(events.select("slug"), "slug", "left_anti"),
        "event-without-link": derived.join(linked, "slug", "left_anti"),
        "event-linked-twice": several,
        "event-without-source": lacks_child(derived, sources, "slug", "event_slug"),
        "source-without-event": lacks_child(sources, events, "event_slug", "slug"),
        "duplicate-slug": events.groupBy("slug").count().filter("`count` > 1"),
        "public": derived.filter("is_public"),
        "titled": derived.filter("title is not null"),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("problem"), "n") for k, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def assert_promotion(candidates: DataFrame, events: DataFrame, sources: DataFrame) -> None:
    bad = {r["problem"]: r["n"] for r in promotion_problems(candidates, events, sources).collect() if r["n"]}
    if bad:
        raise ValueError(f"promotion left {bad}")


def set_origin(events: DataFrame, candidates: DataFrame, origin: str = "source-derived", undo: str | None = None) -> DataFrame:
    """Events that a candidate links get ``origin`` (or, undone, ``undo``); all others stay. Raises if the sets do not match after."""
    ids = candidates.filter("linked_event_id is not null").select(F.col("linked_event_id").alias("slug"), F.lit(True).alias("hit")).distinct()
    out = events.join(ids, "slug", "left")
    value = F.when(F.col("hit"), F.lit(undo or origin)).otherwise(F.col("origin"))
    out = out.withColumn("action", F.when(F.col("hit") & differs(F.col("origin"), value), "update").otherwise("noop"))
    out = out.withColumn("origin", value).drop("hit")
    if undo is None:
        lost = events.join(ids, "slug", "left_semi").select("slug")
        assert_set_equal(out.filter(F.col("origin") == origin).join(ids, "slug", "left_semi").select("slug"), lost)
    return out.select(*events.columns, "action")


def publish(events: DataFrame, titles: DataFrame, at: str) -> DataFrame:
    """Events of the batch (slug, title) get their title, become public and are stamped once; nothing else changes."""
    t = titles.select("slug", F.col("title").alias("new_title"), F.lit(True).alias("hit"))
    out = events.join(t, "slug", "left")
    hit = F.coalesce("hit", F.lit(False))
    out = out.withColumns(
        {
            "title": F.when(hit, F.col("new_title")).otherwise(F.col("title")),
            "is_public": hit | F.col("is_public"),
            "first_published_at": F.when(hit, F.coalesce("first_published_at", F.lit(at).cast("timestamp"))).otherwise(F.col("first_published_at")),
            "action": F.when(hit & ~F.col("is_public"), "update").otherwise("noop"),
        }
    )
    return out.select(*events.columns, "action")


def unpublish(events: DataFrame, slugs: DataFrame) -> DataFrame:
    """Exactly these events become private and lose their title; the time of first publication stays."""
    out = events.join(slugs.select("slug", F.lit(True).alias("hit")), "slug", "left")
    hit = F.coalesce("hit", F.lit(False))
    out = out.withColumns(
        {
            "title": F.when(hit, F.lit(None).cast("string")).otherwise(F.col("title")),
            "is_public": F.col("is_public") & ~hit,
            "action": F.when(hit & F.col("is_public"), "update").otherwise("noop"),
        }
    )
    return out.select(*events.columns, "action")


def upsert_by_key(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Insert new keys; update a row only when some column that the source has differs."""
    update = [c for c in source.columns if c not in key]
    return merged(target, source, key, lambda t, s: any_differs([(t(c), s(c)) for c in update]), update)


def publish_sourced(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events become public where they have a source; the last step of an import."""
    have = sources.select(F.col("event_slug").alias("slug"), F.lit(True).alias("sourced")).distinct()
    out = events.join(have, "slug", "left").withColumn("is_public", F.coalesce("sourced", F.lit(False)) | F.col("is_public"))
    return out.select(*events.columns)


def delete_exact_set(events: DataFrame, sources: DataFrame, candidates: DataFrame, slugs: DataFrame):
    """(events, sources, candidates) without the listed events, their sources and the links to them. Raises if one is left."""
    s = slugs.select("slug").distinct()
    e = events.join(s, "slug", "left_anti").select(*events.columns)
    src = sources.join(s.withColumnRenamed("slug", "event_slug"), "event_slug", "left_anti").select(*sources.columns)
    c = candidates.join(s.select(F.col("slug").alias("linked_event_id"), F.lit(True).alias("gone")), "linked_event_id", "left")
    c = c.withColumn("linked_event_id", F.when(F.col("gone").isNull(), F.col("linked_event_id"))).select(*candidates.columns)
    if not e.join(s, "slug", "left_semi").isEmpty():
        raise ValueError("listed events are left")
    return e, src, c


def backfill_where_unknown(events: DataFrame, override: DataFrame, places: DataFrame) -> DataFrame:
    """Curated events of unknown precision get the level of their override's place; other rows stay."""
    o = override.join(places.select(F.col("key").alias("lookup_key"), F.col("level").alias("new_level")), "lookup_key").select(
        F.col("location_text").alias("o_text"), F.col("location_country_code").alias("o_country"), "new_level"
    )
    same = F.col("location_text").eqNullSafe(F.col("o_text")) & F.col("location_country_code").eqNullSafe(F.col("o_country"))
    out = events.join(o, same, "left")
    hit = F.coalesce((F.col("origin") == "curated") & (F.col("location_precision") == "unknown") & F.col("new_level").isNotNull(), F.lit(False))
    out = out.withColumn("action", F.when(hit, "update").otherwise("noop"))
    out = out.withColumn("location_precision", F.when(hit, F.col("new_level")).otherwise(F.col("location_precision")))
    return out.select(*events.columns, "action")


def undo_backfill(events: DataFrame, changed: DataFrame) -> DataFrame:
    """Exactly the listed slugs get their unknown precision back."""
    out = events.join(changed.select("slug", F.lit(True).alias("hit")).distinct(), "slug", "left")
    value = F.when(F.col("hit"), F.lit("unknown")).otherwise(F.col("location_precision"))
    return out.withColumn("location_precision", value).select(*events.columns)


def stamp_first_published(events: DataFrame, at: str) -> DataFrame:
    """The first time an event is public is stamped once."""
    stamp = F.coalesce("first_published_at", F.when(F.col("is_public"), F.lit(at).cast("timestamp")))
    return events.withColumn("first_published_at", stamp)


def convert_submissions(submissions: DataFrame):
    """(events, sources, submissions): a private draft and a source for each accepted submission, linked back; linked ones keep theirs."""
    slug = hash_slug("submission-", F.col("id").cast("string"))
    todo = submissions.filter("status = 'accepted' and linked_event_id is null").withColumn("slug", slug)
    drafts = todo.select("slug", F.lit(False).alias("is_public"), F.col("what_happened").alias("summary"), "developer_or_operator", "location_text", F.lit("curated").alias("origin"))
    sources = todo.select(F.col("slug").alias("event_slug"), F.col("evidence_url").alias("url"))
    link = F.coalesce("linked_event_id", F.when(F.col("status") == "accepted", slug))
    return drafts, sources, submissions.withColumn("linked_event_id", link)


def apply_reviews(submissions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Submissions with their latest review (id, ord, status, reviewer, reviewed_at).

    A change of status stamps reviewer and time, going back to pending clears
    them, and no change keeps what is there.
    """
    last = latest_version(reviews.withColumn("src_ord", F.col("ord")), ("id",), "ord", "src_ord")
    r = last.select("id", F.col("status").alias("r_status"), F.col("reviewer").alias("r_reviewer"), F.col("reviewed_at").alias("r_at"))
    out = submissions.join(r, "id", "left")
    new = F.coalesce("r_status", "status")
    moved = differs(new, F.col("status"))
    stamp = lambda old, value: F.when(moved & (new == "pending"), F.lit(None)).when(moved, F.col(value)).otherwise(F.col(old))
    out = out.withColumns(
        {"reviewer": stamp("reviewer", "r_reviewer"), "reviewed_at": stamp("reviewed_at", "r_at"), "action": F.when(moved, "update").otherwise("noop"), "status": new}
    )
    return out.select(*submissions.columns, "action")
