"""Curated imports: checks broken one at a time, slugs, references, upserts; queues and labels."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import catalogue, dedupe, dictionary, merge, quality
from faultline.plans import pipelines

SOURCE = "struct<source_url:string,media_id:string,is_event_video:boolean,media_kind:string>"
RECORD = (
    "legacy_id string, collection string, legacy_title string, decision string, decision_reason string, review_status string, "
    "event_type string, valence string, automation_status string, causation_status string, event_date date, event_date_precision string, "
    f"location_country_code string, observable_evidence array<string>, unknowns array<string>, summary string, proposed_title string, "
    f"duplicate_status string, duplicate_of string, sources array<{SOURCE}>"
)


def record(i, **over):
    import datetime

    base = dict(
        legacy_id=f"L{i}", collection="first-hand", legacy_title="t", decision="import", decision_reason="r", review_status="curator-reviewed",
        event_type="collision", valence="neutral-or-unclear", automation_status="unknown", causation_status="undetermined",
        event_date=datetime.date(2024, 5, 1), event_date_precision="month", location_country_code="US", observable_evidence=["o"], unknowns=["u"],
        summary="s", proposed_title=f"Title number {i}", duplicate_status="unique", duplicate_of=None,
        sources=[(f"https://a.example/{i}", f"m{i}", True, "video")],
    )
    base.update(over)
    return tuple(base.values())


@pytest.fixture(scope="module")
def existing(spark):
    return spark.createDataFrame([("known-event",), ("title-number-3",)], "slug string")


FAULTS = [
    ({"decision": "maybe"}, {"decision", "import-only"}),
    ({"decision_reason": " "}, {"decision-reason"}),
    ({"legacy_title": None}, {"legacy-title"}),
    ({"sources": [("https://a.example/x", None, False, "video")]}, {"event-video"}),
    ({"review_status": "draft"}, {"review"}),
    ({"event_type": "crash"}, {"enum:event_type"}),
    ({"automation_status": "driving-automation-engaged-confirmed", "collection": "community"}, {"confirmed"}),
    ({"event_date": None}, {"date-pair"}),
    ({"location_country_code": "usa"}, {"country"}),
    ({"observable_evidence": []}, {"empty:observable_evidence"}),
    ({"summary": ""}, {"blank:summary"}),
    ({"sources": [("ftp://a", None, True, "video")]}, {"source-url"}),
    ({"decision": "deferred"}, {"import-only"}),
    ({"duplicate_of": "L0"}, {"unique-of"}),
    ({"duplicate_status": "related"}, {"duplicate-of"}),
    ({"duplicate_status": "related", "duplicate_of": "nowhere"}, {"unresolved-duplicate"}),
    ({"duplicate_status": "exact-duplicate", "duplicate_of": "known-event"}, {"duplicate-import"}),
    ({"sources": [("https://a.example/x", "m0", True, "video")]}, {"duplicate-media"}),
]


def test_manifest_faults(spark, existing):
    rows = [record(0)] + [record(i + 1, **f) for i, (f, _) in enumerate(FAULTS)]
    got = {}
    for r in quality.manifest_violations(spark.createDataFrame(rows, RECORD), existing).collect():
        got.setdefault(r.key, set()).add(r.rule)
    assert got.pop("m0") == {"duplicate-media"}
    want = {f"L{i + 1}": rules for i, (_, rules) in enumerate(FAULTS) if rules != {"duplicate-media"}}
    assert got == want


def test_curated_import(spark, existing):
    rows = [record(0), record(1, proposed_title="Title number 0!"), record(2, decision="rejected", review_status=None, sources=[]), record(3), record(4)]
    overrides = spark.createDataFrame([("L4", "chosen")], "legacy_id string, slug string")
    target = spark.createDataFrame([], "slug string, summary string, valence string")
    out = pipelines.curated_import(spark.createDataFrame(rows, RECORD), existing, overrides, target)
    slugs = {r.legacy_id: (r.slug, r.method) for r in out["slugs"].collect()}
    assert slugs == {
        "L0": ("title-number-0-l0", "full+disambiguated"),
        "L1": ("title-number-0-l1", "full+disambiguated"),
        "L3": ("title-number-3-l3", "full+disambiguated"),
        "L4": ("chosen", "override"),
    }
    assert out["violations"].count() == 0
    events = out["events"]
    assert {r.action for r in events.collect()} == {"insert"}
    again = merge.upsert_by_key(events.drop("action"), events.drop("action"), ["slug"])
    assert {r.action for r in again.collect()} == {"noop"}


def test_references_and_duplicates(spark, existing):
    rows = [record(0), record(1, duplicate_status="related", duplicate_of="L0"), record(2, duplicate_of="gone"), record(3, duplicate_of="known-event")]
    lost = dedupe.resolve_references(spark.createDataFrame(rows, RECORD), existing)
    assert [r.legacy_id for r in lost.collect()] == ["L2"]
    schema = "k string, url string, media_id string"
    own = spark.createDataFrame([("a", "http://x.example/1/", "m"), ("b", "https://WWW.x.example/1?z", None), ("c", "http://y.example", None)], schema)
    known = spark.createDataFrame([("e1", "https://x.example/1", None), ("e2", None, "m")], schema)
    got = dedupe.exact_duplicates(own.withColumnRenamed("k", "legacy_id"), known.withColumnRenamed("k", "slug"))
    assert {(r.legacy_id, r.slug) for r in got.collect()} == {("a", "e2"), ("b", "e1")}


def test_duplicate_tiers(spark):
    import datetime

    d = datetime.date
    rows = [
        ("1", "http://a.example/x", "Acme", d(2024, 1, 10), "P", "collision", "Van met AV at night"),
        ("2", "https://www.a.example/x/", "Other", d(2023, 1, 1), "Q", "other", "Elsewhere"),
        ("3", "http://b.example", "acme", d(2024, 1, 12), "P", "collision", "Something else entirely"),
        ("4", "http://c.example", "Acme", d(2024, 1, 13), "R", "collision", "Van met AV at nights"),
        ("5", "http://d.example", "Acme", d(2024, 3, 1), "P", "collision", "Van met AV at night"),
    ]
    df = spark.createDataFrame(rows, "id string, url string, operator string, occurred_on date, place string, event_type string, title string")
    assert {(r.a, r.b, r.tier) for r in dedupe.duplicate_tiers(df).collect()} == {("1", "2", 1), ("1", "3", 2), ("1", "4", 3)}


def test_title_tier_against_all_pairs(spark):
    import datetime
    import random

    rnd = random.Random(5)
    titles = ["Van met AV at night", "A van met AV at night", "Bus stopped", "The bus stopped here", "Cyclist hit door", "x", "Xy", "At night a van met AV"]
    rows = []
    for i in range(160):
        t = rnd.choice(titles) + rnd.choice(["", "", " again", " in Phoenix", f" {rnd.randint(1, 40)}"])
        day = datetime.date(2024, 1, 1) + datetime.timedelta(rnd.randint(0, 150))
        rows.append((f"r{i:03d}", None, rnd.choice(["Acme", "acme", "Zoox"]), day, f"p{i}", rnd.choice(["collision", None]), t))
    for i, (t, n) in enumerate([("Van met AV at night", 1), ("Bus stopped", 2), ("A van met AV at night", 12)]):
        rows.append((f"s{i}", None, "Solo", datetime.date(1970, 1, 10) + datetime.timedelta(n), f"q{i}", "collision", t))
    df = spark.createDataFrame(rows, "id string, url string, operator string, occurred_on date, place string, event_type string, title string")
    grams = lambda t: {t.lower()[i : i + 3] for i in range(max(len(t) - 2, 1))}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and (a[2].lower(), a[5]) == (b[2].lower(), b[5]) and abs((a[3] - b[3]).days) <= 14:
                x, y = grams(a[6]), grams(b[6])
                if 2 * len(x & y) >= len(x | y):
                    want.add((a[0], b[0]))
    got = {(r.a, r.b) for r in dedupe.duplicate_tiers(df).collect() if r.tier == 3}

    def groups(pairs):
        up = {r[0]: r[0] for r in rows}
        for a, b in pairs:
            low = min(up[a], up[b])
            if up[a] == up[b]:
                continue
            up = {k: low if v in (up[a], up[b]) else v for k, v in up.items()}
        return up

    assert got <= want and groups(got) == groups(want) and ("s0", "s2") in got


def test_queue_labels_and_counts(spark):
    subs = spark.createDataFrame(
        [(1, "http://a", "pending", None, "x", "a@b.c", "http://b\n\nnote"), (2, "http://c", "pending", "2024-01-02", None, None, None)],
        "id int, evidence_url string, status string, event_date string, what_happened string, submitter_email string, additional_urls string",
    )
    got = {r.id: (r.has_text, r.has_email, r.extra_urls) for r in catalogue.submission_summary(subs).collect()}
    assert got == {1: (True, True, 2), 2: (False, False, 0)}
    queue = catalogue.queue_order(subs.withColumn("created_at", F.lit("2024")))
    assert [r.id for r in queue.collect()] == [2, 1]
    labels = spark.createDataFrame([("collision", "Collision")], "value string, label string")
    e = spark.createDataFrame([("a", "collision"), ("b", "odd"), ("c", None)], "slug string, event_type string")
    named, misses = dictionary.label_of(e, labels, "event_type")
    assert {r.slug: r.label for r in named.collect()} == {"a": "Collision", "b": None, "c": None}
    assert [r.event_type for r in misses.collect()] == ["odd"]
    assert quality.reject_unknown_enum(e, "slug", "event_type", labels).count() == 1
    quality.assert_counts({"a": 1}, {"a": 1})
    with pytest.raises(ValueError, match="approved"):
        quality.assert_counts({"a": 1}, {"a": 2})
    with pytest.raises(ValueError, match="differ"):
        merge.assert_set_equal(e.select("slug"), e.limit(1).select("slug"))
    lacks = merge.missing_expected(e.select("slug"), e.limit(2).select("slug"), ["slug"])
    assert lacks.count() == 1


def test_reviews_and_submissions(spark):
    at = F.lit("2026-01-01").cast("timestamp")
    subs = spark.createDataFrame([(1, "pending", None), (2, "accepted", "old"), (3, "pending", None)], "id int, status string, reviewer string").withColumn("reviewed_at", F.when(F.col("id") == 2, at))
    reviews = spark.createDataFrame([(1, 1, "rejected", "x"), (1, 2, "accepted", "y"), (2, 1, "pending", "z")], "id int, ord int, status string, reviewer string").withColumn("reviewed_at", at)
    got = {r.id: (r.status, r.reviewer, r.reviewed_at is not None, r.action) for r in merge.apply_reviews(subs, reviews).collect()}
    assert got == {1: ("accepted", "y", True, "update"), 2: ("pending", None, False, "update"), 3: ("pending", None, False, "noop")}
    full = subs.withColumns({"evidence_url": F.lit("http://a"), "what_happened": F.lit("w"), "developer_or_operator": F.lit("d"), "location_text": F.lit("l"), "linked_event_id": F.lit(None).cast("string")})
    drafts, sources, linked = merge.convert_submissions(full)
    assert (drafts.count(), sources.count()) == (1, 1)
    again = merge.convert_submissions(linked)
    assert again[0].count() == 0 and sorted(map(str, again[2].collect())) == sorted(map(str, linked.collect()))
