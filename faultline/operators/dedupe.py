"""Slugs that must be distinct, and records that say the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import fold_name, normalize_url, slug_from_title
from ..sources.io import stored

#: Characters of a title gram.
TRIGRAM = 3


def disambiguate_slugs(df: DataFrame, existing: DataFrame, key: str = "legacy_id") -> DataFrame:
    """Adds final ``slug`` and ``method`` to rows with raw_slug and method.

    A raw slug that several rows hold, or that exists already, gets the row's
    id appended for all its holders; a slug with method ``override`` never
    changes. Holders are counted by slug with a partial step and joined back,
    so a slug that very many rows hold is no group of rows.
    """
    held = df.groupBy("raw_slug").agg(F.count(F.lit(1)).alias("holders"))
    taken = existing.select(F.col("slug").alias("raw_slug"), F.lit(True).alias("taken")).distinct()
    out = df.join(held, "raw_slug").join(taken, "raw_slug", "left")
    contested = ((F.col("holders") > 1) | F.coalesce("taken", F.lit(False))) & (F.col("method") != "override")
    suffixed = F.concat("raw_slug", F.lit("-"), F.lower(F.col(key).cast("string")))
    return out.withColumn("slug", F.when(contested, suffixed).otherwise(F.col("raw_slug"))).withColumn(
        "method", F.when(contested, F.concat("method", F.lit("+disambiguated"))).otherwise(F.col("method"))
    ).drop("holders", "taken")


def title_slugs(df: DataFrame, title: str, existing: DataFrame, overrides: DataFrame | None = None, key: str = "legacy_id") -> DataFrame:
    """Slugs of titles: overrides (key, slug) as they are, others made from the title and disambiguated."""
    made = df.withColumn("_s", slug_from_title(F.col(title)))
    raw, method = F.col("_s.slug"), F.col("_s.method")
    if overrides is not None:
        made = made.join(overrides.select(key, F.col("slug").alias("_o")), key, "left")
        raw, method = F.coalesce("_o", raw), F.when(F.col("_o").isNotNull(), "override").otherwise(method)
    made = made.withColumn("raw_slug", raw).withColumn("method", method)
    return disambiguate_slugs(made.drop("_s", "_o"), existing, key)


def resolve_references(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose duplicate_of is neither a record's id nor an existing slug."""
    known = records.select(F.col("legacy_id").alias("duplicate_of")).unionByName(existing.select(F.col("slug").alias("duplicate_of")))
    return records.filter("duplicate_of is not null").join(known.distinct(), "duplicate_of", "left_anti")


def exact_duplicates(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """(legacy_id, slug, match): sources that an existing event has, by media id, else by normalised URL.

    Both sides have media_id and url. Two equi joins; a source that its media
    id finds is not looked up by URL.
    """
    by_id = existing.filter("media_id is not null").select("media_id", "slug").distinct()
    hit = sources.join(by_id, "media_id", "left")
    url = normalize_url(F.col("url"))
    by_url = existing.filter("url is not null").select(url.alias("url_key"), F.col("slug").alias("url_slug")).distinct()
    first = hit.filter("slug is not null").select("legacy_id", "slug", F.concat(F.lit("media "), "media_id").alias("match"))
    rest = hit.filter("slug is null").withColumn("url_key", url).join(by_url, "url_key")
    return first.unionByName(rest.select("legacy_id", F.col("url_slug").alias("slug"), F.concat(F.lit("url "), "url_key").alias("match")))


def grams(c: Column) -> Column:
    """Distinct trigrams of a text; a shorter text is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - TRIGRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(TRIGRAM))))


def similar_titles(classes: DataFrame, window: int, similarity: float) -> DataFrame:
    """Distinct (block, t, u), t < u: titles of one block, some of them at most a slot apart, with Jaccard of trigrams >= ``similarity``.

    ``classes`` has block, t and day. Exact: grams are ordered by how many
    titles hold them, rarest first, and two similar titles share one of the
    first n - ceil(similarity * n) + 1 of each; candidates of that equality
    join are verified on all grams.
    """
    titles = classes.select("t").distinct().withColumn("g", grams(F.col("t")))
    each = titles.select("t", F.explode("g").alias("gram"))
    held = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(held, "gram").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    n = F.size("g")
    # The small term keeps rounding from shortening a prefix.
    first = n - F.ceil(n * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    prefix = ranked.select("t", n.alias("n"), F.explode(F.slice("g", 1, F.least(first, n))["gram"]).alias("gram"))
    slots = classes.select("block", "t", F.floor(F.col("day") / window).alias("slot")).distinct()
    keyed = slots.join(prefix, "t")
    both = keyed.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1))).distinct()
    other = both.select("block", "slot", "gram", F.col("t").alias("u"), F.col("n").alias("m"))
    found = both.join(other, ["block", "slot", "gram"]).filter("t < u")
    sized = (F.col("m") >= F.col("n") * similarity - 1e-9) & (F.col("n") >= F.col("m") * similarity - 1e-9)
    pairs = found.filter(sized).select("block", "t", "u").distinct()
    g, h = grams(F.col("t")), grams(F.col("u"))
    return pairs.filter(F.size(F.array_intersect(g, h)) / F.size(F.array_union(g, h)) >= similarity)


def title_links(dated: DataFrame, window: int, similarity: float) -> DataFrame:
    """(a, b) that connect all records of one block with similar titles at most ``window`` days apart; each is such a pair.

    Records of one block, title and day are one class behind its smallest id.
    A class is linked with the one before it of its own title, and with the
    one before it of each similar title; what lies further back is reached
    over those.
    """
    records = dated.filter("title is not null").select("block", F.lower("title").alias("t"), "day", "id")
    classes = records.groupBy("block", "t", "day").agg(F.min("id").alias("rep"))
    same = records.join(classes, ["block", "t", "day"]).filter("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))
    own = Window.partitionBy("block", "t").orderBy("day")
    before = classes.withColumn("x", F.lag("rep").over(own)).withColumn("x_day", F.lag("day").over(own))
    pairs = stored(similar_titles(classes, window, similarity))  # read on two sides below
    sides = pairs.select("block", "t", "u", F.lit(0).alias("side"), F.col("t").alias("v")).unionByName(
        pairs.select("block", "t", "u", F.lit(1).alias("side"), F.col("u").alias("v"))
    )
    rows = sides.join(classes.withColumnRenamed("t", "v"), ["block", "v"])
    upto = Window.partitionBy("block", "t", "u").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.last(F.when(F.col("side") == side, F.struct(F.col("rep").alias("x"), F.col("day").alias("x_day"))), True).over(upto)
    rows = rows.withColumns({"l0": last(0), "l1": last(1)}).withColumn("l", F.when(F.col("side") == 0, F.col("l1")).otherwise(F.col("l0")))
    across = rows.select("day", "rep", "l.x", "l.x_day")
    linked = before.select("day", "rep", "x", "x_day").unionByName(across).filter(F.col("day") - F.col("x_day") <= window)
    out = linked.select("x", F.col("rep").alias("y")).unionByName(same)
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def duplicate_tiers(df: DataFrame, days: int = 3, window: int = 14, similarity: float = 0.5) -> DataFrame:
    """(a, b, tier): likely duplicates of records (id, url, operator, occurred_on, place, event_type, title).

    Tier 1: equal digest of the normalised URL. Tier 2: equal operator, place
    and type, all of them known, at most ``days`` apart. Tier 3: equal
    operator and type, at most ``window`` days apart and Jaccard similarity of
    title trigrams. The pairs connect all records of a tier that belong
    together, over a representative of each URL, each signature and day, or
    each title and day, so a group of any size gives about as many rows as it
    has members, and no group is gathered.
    """
    keyed = df.withColumn("u", F.sha2(normalize_url(F.col("url")), 256))
    leads = keyed.filter("u is not null").groupBy("u").agg(F.min("id").alias("a"))
    first = keyed.join(leads, "u")
    one = first.filter("a <> id").select("a", F.col("id").alias("b"), F.lit(1).alias("tier"))
    day = F.unix_date("occurred_on")
    dated = df.filter("occurred_on is not null and operator is not null").withColumn("day", day).withColumn("operator", fold_name(F.col("operator")))
    sign = ["operator", "event_type", "place"]
    signed = dated.filter("event_type is not null and place is not null").select(*sign, "day", "id")
    classes = signed.groupBy(*sign, "day").agg(F.min("id").alias("rep"))
    same = signed.join(classes, [*sign, "day"]).filter("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))
    chained = Window.partitionBy(*sign).orderBy("day")  # one row for a day
    near = classes.select("day", F.col("rep").alias("y"), F.lag("rep").over(chained).alias("x"), F.lag("day").over(chained).alias("before"))
    two = near.filter(F.col("day") - F.col("before") <= days).select("x", "y").unionByName(same)
    two = two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(2).alias("tier"))
    block = F.to_json(F.array("operator", "event_type"))
    three = title_links(dated.withColumn("block", block), window, similarity).withColumn("tier", F.lit(3))
    return one.unionByName(two).unionByName(three).groupBy("a", "b").agg(F.min("tier").alias("tier"))


def score_labels(truth: DataFrame, predicted: DataFrame, key: str, fields: list[str], subset: str | None = None) -> DataFrame:
    """Scores of a labelling by field (and subset): rows, predicted, correct, precision, recall, abstention.

    A null prediction abstains; a null truth is not scored.
    """
    p = predicted.select(key, *(F.col(f).alias(f"p_{f}") for f in fields))
    both = truth.join(p, key, "left")
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t"), F.col(f"p_{f}").cast("string").alias("p")) for f in fields)))
    rows = both.select(F.col(subset).cast("string").alias("subset") if subset else F.lit("all").alias("subset"), long.alias("x")).select("subset", "x.*")
    agg = rows.filter("t is not null").groupBy("field", "subset").agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.col("p").isNotNull()).alias("predicted"),
        F.count_if(F.col("p") == F.col("t")).alias("correct"),
    )
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return agg.withColumns(
        {
            "precision": ratio("correct", "predicted"),
            "recall": ratio("correct", "scored"),
            "abstention": F.round(1 - F.col("predicted") / F.col("scored"), 6),
        }
    )


#: Records of one gram key that a task compares with the others of that key; larger ones are cut into chunks of this size.
HOT_GRAM = 10_000
#: Weights of the grams of a title and of a lede.
TITLE_WEIGHT, LEDE_WEIGHT = 2, 1
SIDE = ["id", "block", "day", "grams", "weight"]


def weighted_grams(title: Column, lede: Column) -> Column:
    """array of struct(g, w): distinct trigrams of the lower-case title and lede, apart by field, with their weights."""
    def of(text: Column, tag: str, weight: int) -> Column:
        found = F.when(F.length(text) > 0, F.transform(grams(F.lower(text)), lambda g: F.struct(F.concat(F.lit(tag), g).alias("g"), F.lit(weight).alias("w"))))
        return F.coalesce(found, F.array().cast("array<struct<g: string, w: int>>"))

    return F.concat(of(title, "t:", TITLE_WEIGHT), of(lede, "l:", LEDE_WEIGHT))


def _side(df: DataFrame) -> DataFrame:
    """Records with known operator and date as (id, block, day, grams, weight)."""
    block = F.to_json(F.array(fold_name(F.col("operator")), F.col("event_type")))
    rows = df.filter("occurred_on is not null and operator is not null").select(
        "id", block.alias("block"), F.unix_date("occurred_on").alias("day"), weighted_grams(F.col("title"), F.col("lede")).alias("grams")
    )
    total = F.aggregate("grams", F.lit(0), lambda n, g: n + g["w"])
    return rows.withColumn("weight", total).filter("weight > 0")


def _prefixes(side: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """(id, block, day, weight, g): grams of which two similar records share one, rarest first.

    The grams after the prefix weigh less than ``similarity`` of the whole, so
    two records that share only such grams can't reach it.
    """
    each = side.select("id", F.explode("grams").alias("x")).select("id", "x.g", "x.w").join(held, "g")
    order = Window.partitionBy("id").orderBy("df", "g").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # What this gram and all after it weigh; once that is too little, no gram further on is needed.
    ranked = each.withColumn("rest", F.sum("w").over(order)).join(side.drop("grams"), "id")
    return ranked.filter(F.col("rest") >= F.col("weight") * similarity - 1e-9).select("id", "block", "day", "weight", "g")


def similar_records(incoming: DataFrame, existing: DataFrame, window: int = 14, similarity: float = 0.5) -> DataFrame:
    """(id, match, score): pairs of an incoming and an existing record (id, operator, event_type, occurred_on, title, lede) that are similar.

    Equal operator and type, at most ``window`` days apart, weighted Jaccard
    of the trigrams of title and lede of at least ``similarity``. Exact: a
    prefix filter finds candidates by an equality join on block, slot of days
    and gram, and all grams verify them. A gram that more than ``HOT_GRAM``
    existing records of one block and slot share is cut into chunks by a hash
    of the record, and an incoming record visits each of them. Existing
    records of blocks and slots that no incoming one can meet are left out
    before their grams are made.
    """
    a, slot = stored(_side(incoming)), F.floor(F.col("day") / window)
    near = F.explode(F.array(slot - 1, slot, slot + 1))
    met = a.select("block", near.alias("slot")).distinct()
    b = stored(_side(existing).withColumn("slot", slot).join(met, ["block", "slot"], "left_semi").select(*SIDE))
    count = lambda df: df.select(F.explode("grams.g").alias("g"))
    held = stored(count(a).unionByName(count(b)).groupBy("g").agg(F.count(F.lit(1)).alias("df")))
    left = _prefixes(a, held, similarity).withColumn("slot", near)
    right = _prefixes(b, held, similarity).withColumn("slot", slot)
    key = ["block", "slot", "g"]
    right = stored(right.select(F.col("id").alias("match"), F.col("day").alias("match_day"), F.col("weight").alias("match_weight"), *key))
    hot = right.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / HOT_GRAM).cast("int").alias("chunks")).filter("chunks > 1")
    chunks = F.coalesce("chunks", F.lit(1))
    right = right.join(hot, key, "left").withColumn("chunk", F.pmod(F.xxhash64("match"), chunks).cast("int")).drop("chunks")
    left = left.join(hot, key, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    pairs = left.join(right, [*key, "chunk"]).filter(
        (F.abs(F.col("day") - F.col("match_day")) <= window)
        & (F.least("weight", "match_weight") >= F.greatest("weight", "match_weight") * similarity - 1e-9)
    )
    pairs = pairs.select("id", "match").distinct()
    other = b.select(F.col("id").alias("match"), F.col("grams").alias("h"), F.col("weight").alias("v"))
    both = pairs.join(a.select("id", "grams", "weight"), "id").join(other, "match")
    common = F.aggregate(F.array_intersect("grams", "h"), F.lit(0), lambda n, g: n + g["w"])
    score = common / (F.col("weight") + F.col("v") - common)
    return both.select("id", "match", score.alias("score")).filter(F.col("score") >= similarity)


def resolve_merged(ids: DataFrame, merged: DataFrame, column: str = "match", most_rounds: int = 40) -> DataFrame:
    """``ids`` with ``column`` replaced by where it was merged into in the end; ``merged`` holds (id, merged_into).

    Pointers are doubled round by round, so a chain of n redirects takes log n
    rounds; a circle of redirects is an error. Redirects that point at
    themselves are none.
    """
    cur = stored(merged.filter("merged_into is not null and merged_into <> id").select("id", "merged_into"))
    for _ in range(most_rounds):
        on = cur.select(F.col("id").alias("merged_into"), F.col("merged_into").alias("on"))
        jumped = stored(cur.join(on, "merged_into", "left").select("id", F.coalesce("on", "merged_into").alias("merged_into"), F.col("on").isNotNull().alias("moved")))
        moved, circle = jumped.agg(F.count_if("moved"), F.count_if(F.col("id") == F.col("merged_into"))).first()
        if circle:
            raise ValueError("records are merged into each other in a circle")
        cur = jumped.drop("moved")
        if not moved:
            break
    else:
        raise ValueError("records are merged into each other in a circle")
    ends = cur.select(F.col("id").alias(column), F.col("merged_into").alias("_end"))
    return ids.join(ends, column, "left").withColumn(column, F.coalesce("_end", column)).drop("_end")


def dispositions(
    incoming: DataFrame, existing: DataFrame, merged: DataFrame | None = None, days: int = 3, window: int = 14, similarity: float = 0.5
) -> DataFrame:
    """(id, disposition, match, tier, score) of every incoming record: attach, possible-duplicate or new.

    Records: id, url, operator, occurred_on, place, event_type, title, lede.
    Strong: a source has the same normalised URL (tier 1), or operator, place
    and type agree within ``days`` and the texts are similar as well (tier 2).
    Partial: one of the two alone (tier 2 or 3). The best match is taken: by
    strength, tier, score, then the smallest id, which is followed to the
    record it was merged into. A record without a match is new. An existing
    record that a signature or URL shares with very many is one of them: each
    key keeps its smallest and its nearest day only. Nothing goes before a URL,
    so only records without a known one are compared by their texts.
    """
    url = F.sha2(normalize_url(F.col("url")), 256)
    known = existing.filter("url is not null").groupBy(url.alias("u")).agg(F.min("id").alias("match"))
    one = incoming.select("id", url.alias("u")).join(known, "u").select("id", "match", F.lit(1).alias("tier"), F.lit(None).cast("double").alias("score"))
    one = stored(one)
    texts = stored(similar_records(incoming.join(one.select("id"), "id", "left_anti"), existing, window, similarity))

    def signed(df: DataFrame) -> DataFrame:
        rows = df.filter("occurred_on is not null and operator is not null and place is not null and event_type is not null")
        return rows.select("id", fold_name(F.col("operator")).alias("op"), "place", "event_type", F.unix_date("occurred_on").alias("day"))

    sign = ["op", "place", "event_type"]
    days_of = signed(existing).groupBy(*sign, "day").agg(F.min("id").alias("match"))
    near = signed(incoming).withColumn("to", F.explode(F.sequence(F.col("day") - days, F.col("day") + days)))
    met = near.join(days_of.withColumnRenamed("day", "to"), [*sign, "to"])
    gap = F.abs(F.col("to") - F.col("day"))
    two = met.groupBy("id").agg(F.min(F.struct(gap.alias("gap"), "match")).alias("m")).select("id", "m.match")
    # Similar records whose signature agrees too are strong.
    pairs = texts.join(signed(incoming).withColumnRenamed("day", "d1"), "id", "left").join(
        signed(existing).select(F.col("id").alias("match"), *(F.col(c).alias(f"e_{c}") for c in sign), F.col("day").alias("d2")), "match", "left"
    )
    agree = (F.abs(F.col("d1") - F.col("d2")) <= days)
    for c in sign:
        agree = agree & (F.col(c) == F.col(f"e_{c}"))
    agree = F.coalesce(agree, F.lit(False))
    three = pairs.select("id", "match", F.when(agree, 2).otherwise(3).alias("tier"), "score", agree.alias("strong"))
    every = one.withColumn("strong", F.lit(True)).unionByName(three).unionByName(
        two.withColumns({"tier": F.lit(2), "score": F.lit(None).cast("double"), "strong": F.lit(False)})
    )
    best = every.groupBy("id").agg(F.min(F.struct(~F.col("strong"), "tier", -F.coalesce("score", F.lit(0.0)), "match", "score", "strong")).alias("m"))
    found = best.select("id", "m.match", "m.tier", "m.score", "m.strong")
    if merged is not None:
        found = resolve_merged(found, merged)
    out = incoming.select("id").join(found, "id", "left")
    kind = F.when(F.col("strong"), "attach").when(F.col("match").isNotNull(), "possible-duplicate").otherwise("new")
    return out.select("id", kind.alias("disposition"), "match", "tier", "score")


#: Terms of a sign test that are added up; from there on they are below a double's last digit.
SIGN_TERMS = 200_000


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, by Stirling's series above 20."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test of ``wins`` against ``losses``; 1 without either."""
    n, m = wins + losses, F.least(wins, losses)
    first = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * F.lit(0.6931471805599453)
    # The sum of the binomial's tail, as its largest term times falling ratios.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(m > 0, F.sequence(F.lit(0).cast("long"), F.least(m, F.lit(SIGN_TERMS)) - 1))
    tail = F.aggregate(
        F.coalesce(steps, F.array().cast("array<long>")),
        start,
        lambda s, i: F.struct(
            (s["term"] * (m - i) / (n - m + i + 1)).alias("term"), (s["sum"] + s["term"] * (m - i) / (n - m + i + 1)).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(first) * tail))


def label_transitions(truth: DataFrame, before: DataFrame, after: DataFrame, key: str, fields: list[str], subset: str | None = None) -> DataFrame:
    """Paired comparison of two labellings by field (and subset): what became right, what became wrong, and whether that is chance.

    A missing or null label is not right. Rows without a truth are not scored.
    Counts (scored, kept_right, kept_wrong, fixed, regressed, changed_wrong:
    wrong both times, but not in the same way), the net gain and ``p_value``
    of an exact two-sided sign test on fixed against regressed. One pass: both
    labellings are joined by key, and only counts are grouped.
    """
    b = before.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    a = after.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    both = truth.join(b, key, "left").join(a, key, "left")
    each = F.explode(
        F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t"), F.col(f"b_{f}").alias("b"), F.col(f"a_{f}").alias("a")) for f in fields))
    )
    rows = both.select(F.col(subset).cast("string").alias("subset") if subset else F.lit("all").alias("subset"), each.alias("x")).select("subset", "x.*")
    was, now = (F.coalesce(F.col(c) == F.col("t"), F.lit(False)) for c in ("b", "a"))
    out = rows.filter("t is not null").groupBy("field", "subset").agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(was & now).alias("kept_right"),
        F.count_if(~was & ~now).alias("kept_wrong"),
        F.count_if(~was & now).alias("fixed"),
        F.count_if(was & ~now).alias("regressed"),
        F.count_if(~was & ~now & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed_wrong"),
    )
    return out.withColumns({"net": F.col("fixed") - F.col("regressed"), "p_value": F.round(sign_test(F.col("fixed"), F.col("regressed")), 6)})


def attach_or_create(incoming: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, sources) of a feed after :func:`dispositions`: what attaches is a source of its match, all else is a new event.

    Events are the incoming rows with ``possible_duplicate_of``, null unless
    the match is partial; sources are (event, id, url, title), one for each
    incoming row, of the match or of the row's own new event.
    """
    rows = incoming.join(found.select("id", "disposition", "match"), "id")
    attaches = F.col("disposition") == "attach"
    events = rows.filter(~attaches).select(*incoming.columns, F.when(F.col("disposition") == "possible-duplicate", F.col("match")).alias("possible_duplicate_of"))
    sources = rows.select(F.when(attaches, F.col("match")).otherwise(F.col("id")).alias("event"), "id", "url", "title")
    return events, sources


def merge_events(events: DataFrame, sources: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, sources) after ``merges`` (loser, winner): losers become private redirects, their sources go to the winner.

    Merges may be chained; a loser points at the last winner, and a circle is
    an error. Of sources that an event then holds twice (equal
    external_record_id, nulls apart), one stays. Events get ``merged_into``
    and ``action``; rows that no merge names stay as they are.
    """
    pairs = merges.select(F.col("loser").alias("id"), F.col("winner").alias("merged_into")).filter("id <> merged_into").dropDuplicates(["id"])
    ends = stored(resolve_merged(pairs.select("id", F.col("merged_into").alias("match")), pairs)).select(F.col("id").alias("slug"), F.col("match").alias("_into"))
    lost = F.col("_into").isNotNull()
    out = events.join(ends, "slug", "left").withColumn("is_public", F.col("is_public") & ~lost)
    out = out.select(*events.columns, F.col("_into").alias("merged_into"), F.when(lost, "merge").otherwise("noop").alias("action"))
    moved = sources.join(ends.withColumnRenamed("slug", "event_slug"), "event_slug", "left")
    moved = moved.withColumn("event_slug", F.coalesce("_into", "event_slug")).select(*sources.columns)
    rest = [c for c in sources.columns if c not in ("event_slug", "external_record_id")]
    named = moved.filter("external_record_id is not null").groupBy("event_slug", "external_record_id").agg(F.min(F.struct(*rest)).alias("s"))
    one = named.select("event_slug", "external_record_id", "s.*").select(*sources.columns)
    return out, one.unionByName(moved.filter("external_record_id is null"))
