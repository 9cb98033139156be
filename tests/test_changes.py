"""Merging values, one-pass checks, pages, boxes, duplicates of texts, transitions: held against plain Python."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.operators import catalogue, consolidate, dedupe, geo, quality, versions
from faultline.sources import io

REPORT = (
    "reporting_generation string, report_id string, same_incident_id string, reporting_entity string, developer_or_operator string, incident_date date, "
    "incident_date_precision string, city string, state string, automation_engagement_text string, crash_interaction_counterpart_text string, "
    "subject_vehicle_precrash_movement_text string, other_actor_precrash_movement_text string, injury_outcome_text string, narrative string, first_ord long"
)


def reports(spark, n=400, seed=1):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    rows = []
    for i in range(n):
        month = rng.choice([None, 1, 2])
        rows.append((
            pick("historical", "current"), f"r{i}", pick(None, "a", "b", f"i{i % 60}"), "e", pick(None, "X", "x", "Y"), month and dt.date(2024, month, 1),
            "month" if month else "unknown", pick(None, "P", "Q"), pick("CA", "AZ"), pick(None, "Verified Engaged"), pick(None, "Car", "Bus"), pick(None, "Stopped"),
            pick(None, "Turning", "Straight"), pick(None, "Minor"), pick(None, "The vehicle stopped.", "A truck struck the car in the lane.", "short"), i,
        ))
    return spark.createDataFrame(rows, REPORT)


def test_merged_values_equal_gathered_reports(spark):
    df = reports(spark)
    old, new = consolidate.build_candidates(df), consolidate.consolidate(df)
    old = old.withColumn("n_reports", F.size("reports").cast("long")).select(*new.columns)
    assert sorted(map(str, old.collect())) == sorted(map(str, new.collect()))
    assert consolidate.consolidate(df.limit(0)).count() == 0
    told = consolidate.members(df).groupBy("candidate_id").count().agg(F.sum("count")).first()[0]
    assert told == df.count()


def test_one_incident_of_very_many_reports(spark):
    """What leaves the first aggregate is the distinct values, not the reports; nothing gathers reports."""
    one = reports(spark, 1).first().asDict() | {"same_incident_id": "hot"}
    ids = spark.range(200_000)
    df = ids.select(*(F.lit(v).cast(dict(reports(spark, 1).dtypes)[k]).alias(k) for k, v in one.items() if k not in ("report_id", "first_ord", "city")),
                    F.col("id").cast("string").alias("report_id"), F.col("id").alias("first_ord"), F.concat(F.lit("C"), F.col("id") % 3).alias("city"))
    row = consolidate.consolidate(df).collect()
    assert len(row) == 1 and row[0]["n_reports"] == 200_000
    assert [d["values"] for d in row[0]["disagreements"] if d["field"] == "city"] == [["C0", "C1", "C2"]]
    assert consolidate.stated_values(consolidate.keyed_reports(df)).count() < 20
    plan = consolidate.consolidate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "narrative" in plan and "collect_list(struct(reporting_generation" not in plan


def test_latest_version_takes_any_order(spark):
    rows = [("r", 1, ("b", 0)), ("r", 2, ("a", 5)), ("r", 2, ("a", 4)), ("s", 1, ("z", 9))]
    df = spark.createDataFrame(rows, "report_id string, version long, src_ord struct<file: string, row: long>").withColumn("generation", F.lit("current"))
    got = {r["report_id"]: (r["version"], tuple(r["src_ord"]), tuple(r["first_ord"])) for r in versions.latest_version(df).collect()}
    assert got == {"r": (2, ("a", 4), ("a", 4)), "s": (1, ("z", 9), ("z", 9))}


def test_counted_write_keeps_or_withdraws(spark, tmp_path):
    df = spark.range(1000).withColumn("kind", F.col("id") % 3)
    counts = {"all": F.count(F.lit(1)), "zero": F.count_if(F.col("kind") == 0)}
    good = f"file://{tmp_path}/good"
    assert io.write_counted(df, good, counts, {"all": 1000, "zero": 334}) == {}
    assert spark.read.parquet(good).count() == 1000
    assert io.write_counted(df, f"file://{tmp_path}/bad", counts, {"all": 999, "zero": 334}) == {"all": (1000, 999)}
    assert io.write_counted(df, f"file://{tmp_path}/bad", counts, {"all": 1000}) == {"zero": (334, None)}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["good"]
    assert io.write_counted(df.limit(0), f"file://{tmp_path}/none", counts, {"all": 0, "zero": 0}) == {}


def test_unique_rows_with_equal_nulls(spark):
    rows = [(1, None, "x", True), (2, None, "x", True), (3, "null", "x", True), (4, "a", None, False), (5, "a", None, True), (6, '","', "b", True), (7, '"', ',"b', True)]
    df = spark.createDataFrame(rows, "id long, a string, b string, live boolean")
    assert [(r["key"], r["members"]) for r in quality.unique_rows(df, ["a", "b"], "id", where="live").collect()] == [('[null,"x"]', 2)]
    both = quality.unique_rows(df, ["a", "b"], "id").collect()
    assert sorted(r["key"] for r in both) == ['["a",null]', '[null,"x"]']
    assert quality.unique_rows(df, ["a", "b"], "id", nulls_distinct=True).count() == 0


def test_structural_checks_scan_once(spark):
    e = spark.createDataFrame([], "slug string, candidate_id string, is_public boolean, occurred_on date, occurred_on_precision string, title string, summary string, interpretation string, review_status string, observed_facts array<string>, system_name string, system_version string, system_version_knowledge string, " + ", ".join(f"{f} string" for f in quality.VOCABULARIES))
    s = spark.createDataFrame([], "event_slug string, external_record_id string, published_on date, published_on_precision string, source_type string, url string")
    marks = quality.structural_marks(e, s)
    plan = marks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") <= 2 and "Join" not in plan
    counters = quality.qa_counters(marks, processed=0).first()
    assert counters["generated"] == 0 and counters["ok_one_event_each"] and counters["n_no_source"] == 0


def listed(spark, n=700):
    rng = random.Random(4)
    titles = [None, "a", "A", "b", "é", "z", "Z"]
    rows = [(f"s{i:04}", rng.choice(titles), rng.choice([None, dt.date(2024, rng.randrange(1, 4), 1)])) for i in range(n)]
    df = spark.createDataFrame(rows, "slug string, title string, occurred_on date")
    return df.withColumn("occurred_on_precision", F.when(F.col("occurred_on").isNull(), "unknown").otherwise("month"))


def test_seeking_and_directory_give_all_pages(spark, tmp_path):
    df = listed(spark)
    whole = [r["slug"] for r in df.orderBy(*catalogue.newest_first()).collect()]
    d = catalogue.page_directory(df, f"file://{tmp_path}/pages")
    assert d.rows == 700 and [r["slug"] for r in d.read(spark).orderBy("row").collect()] == whole
    for number in (1, 3, 14, 99, "x", -2):
        rows, counts = d.page(spark, number)
        want, same = catalogue.page(df, number)
        assert [r["slug"] for r in rows.collect()] == [r["slug"] for r in want.collect()] and counts == same
    after, seen = None, []
    key = catalogue.partial_date_sort_key(F.col("occurred_on"), F.col("occurred_on_precision"))
    while rows := catalogue.seek_page(df.withColumn("k", key), after, 120).collect():
        seen += [r["slug"] for r in rows]
        after = (rows[-1]["k"], rows[-1]["title"], rows[-1]["slug"])
    assert seen == whole


def test_a_page_reads_the_parts_that_hold_it(spark, tmp_path):
    df = spark.range(20_000).select(F.format_string("s%06d", "id").alias("slug"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = catalogue.page_directory(df, f"file://{tmp_path}/pages", [F.col("slug")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(d.starts) > 2
    rows, _ = d.page(spark, 2)
    assert [r["slug"] for r in rows.collect()] == [f"s{i:06}" for i in range(50, 100)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(_part" in plan or "_part#" in plan.split("PartitionFilters")[1][:200]
    assert len({r[0] for r in rows.select(F.input_file_name()).collect()}) <= 1
    empty = catalogue.page_directory(df.limit(0), f"file://{tmp_path}/none", [F.col("slug")])
    assert empty.rows == 0 and empty.page(spark, 3)[0].count() == 0


@pytest.mark.parametrize("most", [geo.PUSHED_KEYS, 0])
def test_box_is_pushed_into_the_places(spark, monkeypatch, most):
    monkeypatch.setattr(geo, "PUSHED_KEYS", most)
    places = spark.createDataFrame(
        [("P|AZ|US", "city", 33.4, -112.0), ("AZ|US", "region", 34.0, -111.0), ("US", "country", 39.0, -98.0), ("S|CA|US", "city", 37.7, -122.4), ("CA|US", "region", 36.0, -119.0)],
        "key string, level string, latitude double, longitude double",
    )
    texts = ["P, AZ, US", "Q, AZ, US", "AZ, US", "S, CA, US", "T, NV, US", None, "NV, US", "x"]
    rows = [(f"e{i}", t, "US", "source-derived") for i, t in enumerate(texts)] + [(f"c{i}", t, "US", "curated") for i, t in enumerate(texts)]
    e = spark.createDataFrame(rows, "slug string, location_text string, location_country_code string, origin string").withColumns(
        {"is_public": F.lit(True), "event_type": F.lit("t"), "valence": F.lit("v"), "developer_or_operator": F.lit("d")}
    )
    over = spark.createDataFrame([("T, NV, US", "US", "AZ|US"), (None, "US", "S|CA|US"), ("x", "US", None)], "location_text string, location_country_code string, lookup_key string")
    for box in ((30, 35, -115, -110), (36.5, 40, -125, -90), (33.9, 34.1, -112, -110), (0, 1, 0, 1)):
        want = geo.filter_bounds(geo.event_map(e, over, places), *box)
        got = geo.event_map_in(e, over, places, *box)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        geo.event_map_in(e, over, places, 2, 1, 0, 1)


RECORD = "id long, url string, operator string, occurred_on date, place string, event_type string, title string, lede string"


def records(rng, ids):
    words = ["van", "met", "robotaxi", "night", "stopped", "cyclist", "signal", "lane"]
    text = lambda n: rng.choice([None, "", "ab", " ".join(rng.choice(words) for _ in range(n))])
    return [
        (i, rng.choice([None, f"https://www.x.org/{rng.randrange(400)}/", f"http://x.org/{rng.randrange(400)}?a"]), rng.choice([None, "Op", "OP.", "Q"]),
         rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(60))]), rng.choice([None, "P", "R"]), rng.choice(["c", "d"]), text(4), text(7))
        for i in ids
    ]


def weights(r):
    def grams(t, tag):
        t = (t or "").lower()
        return {tag + t[i : i + 3] for i in range(max(len(t) - 2, 1))} if t else set()

    return {g: 2 for g in grams(r[6], "t:")} | {g: 1 for g in grams(r[7], "l:")}


@pytest.mark.parametrize("hot", [10_000, 2])
def test_similar_texts_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(dedupe, "HOT_GRAM", hot)
    rng = random.Random(7)
    a, b = records(rng, range(120)), records(rng, range(1000, 1250))
    want = set()
    for x in a:
        for y in b:
            if None in (x[2], y[2], x[3], y[3]) or x[2].lower().strip(".") != y[2].lower().strip(".") or x[5] != y[5] or abs((x[3] - y[3]).days) > 14:
                continue
            g, h = weights(x), weights(y)
            common = sum(g[k] for k in g.keys() & h.keys())
            total = sum(g.values()) + sum(h.values()) - common
            if common and common / total >= 0.5:
                want.add((x[0], y[0], round(common / total, 9)))
    left, right = spark.createDataFrame(a, RECORD), spark.createDataFrame(b, RECORD)
    got = [(r["id"], r["match"], round(r["score"], 9)) for r in dedupe.similar_records(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert dedupe.similar_records(left.limit(0), right).count() == 0


def test_dispositions_follow_redirects(spark):
    day = dt.date(2024, 1, 10)
    old = [
        (1, "https://a.org/1", "Op", day, "P", "c", "A van met a robotaxi", "It stopped at night"),
        (2, None, "Op", day, "P", "d", "A bus crossed", None),
        (3, None, "Q", day, "R", "c", "Nothing like it", "at all"),
        (4, "https://a.org/4", "Z", day, "P", "c", None, None),
    ]
    new = [
        (11, "http://www.a.org/1/?x=1", None, None, None, None, None, None),  # same page
        (12, None, "op", day, "P", "c", "A van met a robotaxi", "It stopped at night!"),  # signature and text
        (13, None, "Op", day + dt.timedelta(2), "P", "d", "Other words", None),  # signature alone
        (14, None, "Q", day + dt.timedelta(9), "Elsewhere", "c", "Nothing like it", "at all"),  # text alone
        (15, None, "Q", day + dt.timedelta(30), "R", "c", "Nothing like it", "at all"),
        (16, "https://a.org/4", "Z", day, "P", "c", None, None),
        (17, None, None, None, None, None, None, None),
    ]
    merged = spark.createDataFrame([(1, 5), (5, 6), (6, 7), (4, None), (3, 3)], "id long, merged_into long")
    got = {r["id"]: (r["disposition"], r["match"], r["tier"]) for r in dedupe.dispositions(spark.createDataFrame(new, RECORD), spark.createDataFrame(old, RECORD), merged).collect()}
    assert got == {
        11: ("attach", 7, 1), 12: ("attach", 7, 2), 13: ("possible-duplicate", 2, 2), 14: ("possible-duplicate", 3, 3),
        15: ("new", None, None), 16: ("attach", 4, 1), 17: ("new", None, None),
    }
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, merged_into long")
    with pytest.raises(ValueError, match="circle"):
        dedupe.resolve_merged(spark.createDataFrame([(1, 1)], "id long, match long"), ring, most_rounds=8)


def test_sign_test_is_exact(spark):
    cases = [(0, 0), (1, 0), (5, 0), (3, 9), (10, 10), (30, 51), (1000, 1100), (40_000, 40_900), (7, 300_000)]
    df = spark.createDataFrame(cases, "a long, b long")
    got = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", dedupe.sign_test(F.col("a"), F.col("b")).alias("p")).collect()}
    for a, b in cases:
        n, m = a + b, min(a, b)
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(m + 1)]
        want = 1.0 if n == 0 else min(1.0, 2 * math.fsum(map(math.exp, logs)))
        assert math.isclose(got[a, b], want, rel_tol=1e-6, abs_tol=1e-12), (a, b)


def test_transitions_between_labellings(spark):
    truth = spark.createDataFrame([(i, "x" if i % 2 else "y", None if i == 9 else "s") for i in range(10)], "k long, f string, g string")
    before = spark.createDataFrame([(i, "x", "s") for i in range(8)], "k long, f string, g string")
    after = spark.createDataFrame([(i, "y" if i < 4 else None, "t") for i in range(10)], "k long, f string, g string")
    got = {r["field"]: r.asDict() for r in dedupe.label_transitions(truth, before, after, "k", ["f", "g"]).collect()}
    count = defaultdict(int)
    for i in range(10):
        t, b, a = ("x" if i % 2 else "y"), ("x" if i < 8 else None), ("y" if i < 4 else None)
        count[(b == t, a == t)] += 1
    f = got["f"]
    assert (f["kept_right"], f["regressed"], f["fixed"], f["kept_wrong"]) == tuple(count[k] for k in ((True, True), (True, False), (False, True), (False, False)))
    assert got["g"]["scored"] == 9 and got["g"]["regressed"] == 8 and got["g"]["net"] == -8 and math.isclose(got["g"]["p_value"], 2 / 2**8, abs_tol=1e-6)


def test_transitions_of_sources_and_submissions(spark):
    e = spark.createDataFrame([(1, "a", "t", True), (2, "b", "t", True), (3, "c", "t", False), (4, "d", "t", True)], "id long, slug string, title string, is_public boolean")
    e = e.withColumn("first_published_at", F.lit("2026-01-01").cast("timestamp"))
    s = lambda *slugs: spark.createDataFrame([(x,) for x in slugs], "event_slug string")
    sub = lambda *rows: spark.createDataFrame(rows, "id long, status string, day string").withColumn("reviewed_at", F.col("day").cast("timestamp"))
    before = sub((1, "pending", None), (2, "approved", "2026-01-01"), (3, "pending", None), (4, "approved", "2026-01-01"))
    after = sub((1, "approved", None), (2, "pending", None), (3, "pending", "2026-01-02"), (4, "approved", "2026-01-03"), (5, "rejected", "2026-01-02"))
    found = quality.snapshot_transitions(e, e, (s("a", "a", "b", "c"), s("b", "b")), (before, after))
    assert sorted((r["key"], r["rule"]) for r in found.collect()) == [
        ("1", "unstamped-review"), ("2", "back-to-pending"), ("2", "review-stamp-changed"), ("3", "stamped-while-pending"),
        ("4", "review-stamp-changed"), ("5", "created-reviewed"), ("a", "last-source-lost"), ("d", "public-without-source"),
    ]
    assert quality.snapshot_transitions(e, e).count() == 0


def test_merged_events_redirect_and_keep_sources(spark):
    e = spark.createDataFrame([(s, True) for s in "abcdx"], "slug string, is_public boolean")
    s = spark.createDataFrame([("a", "1", "u"), ("b", "1", "v"), ("b", "2", "w"), ("c", None, "n"), ("d", None, "n"), ("x", "9", "z")], "event_slug string, external_record_id string, url string")
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "x")], "loser string, winner string")
    events, sources = dedupe.merge_events(e, s, merges)
    assert {r["slug"]: (r["is_public"], r["merged_into"], r["action"]) for r in events.collect()} == {
        "a": (False, "c", "merge"), "b": (False, "c", "merge"), "c": (True, None, "noop"), "d": (False, "c", "merge"), "x": (True, None, "noop"),
    }
    assert sorted(map(tuple, sources.collect()), key=str) == [("c", "1", "u"), ("c", "2", "w"), ("c", None, "n"), ("c", None, "n"), ("x", "9", "z")]
    found = spark.createDataFrame([(1, "attach", 7), (2, "possible-duplicate", 8), (3, "new", None)], "id long, disposition string, match long")
    rows = spark.createDataFrame([(1, "u1", "t"), (2, "u2", "t"), (3, None, None)], "id long, url string, title string")
    made, told = dedupe.attach_or_create(rows, found)
    assert sorted((r["id"], r["possible_duplicate_of"]) for r in made.collect()) == [(2, 8), (3, None)]
    assert sorted((r["event"], r["id"]) for r in told.collect()) == [(2, 2), (3, 3), (7, 1)]


def test_records_that_a_url_decides_are_not_compared_by_text(spark, monkeypatch):
    day = dt.date(2024, 1, 10)
    old = [(i, f"https://a.org/{i}", "Op", day, "P", "c", f"A van met robotaxi {i}", "It stopped") for i in range(40)]
    new = [(100 + i, f"https://a.org/{i}", "Op", day, "P", "c", f"A van met robotaxi {i}", "It stopped") for i in range(20)]
    new.append((200, None, "Op", day + dt.timedelta(90), "P", "c", "A van met robotaxi 1", "It stopped"))
    rows, real = [], dedupe.similar_records

    def similar(incoming, *rest):
        found = real(incoming, *rest)
        rows.append((incoming.count(), found.count()))
        return found

    sides, stored = [], dedupe.stored
    monkeypatch.setattr(dedupe, "similar_records", similar)
    monkeypatch.setattr(dedupe, "stored", lambda df: (sides.append(df), stored(df))[1])
    got = {r["id"]: (r["disposition"], r["match"], r["tier"]) for r in dedupe.dispositions(spark.createDataFrame(new, RECORD), spark.createDataFrame(old, RECORD)).collect()}
    assert got == {**{100 + i: ("attach", i, 1) for i in range(20)}, 200: ("new", None, None)}
    assert rows == [(1, 0)]
    # No existing record is near the one that is left, so no grams of any are written.
    assert [df.count() for df in sides if df.columns == dedupe.SIDE] == [1, 0]
