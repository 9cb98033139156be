"""Evidence rules as rows of a table: an index of required words picks the few rules that a text can fire.

A rule is one or more parts, a part one or more patterns in order. A rule
fires on a text when all its parts of sign 1 are there, none of sign -1 is,
and the text has the fact that the rule needs, if any.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import required_texts, required_words
from ..functions.text import identity_key
from . import rules_data as R

RULES = (
    "rule string, kind string, topic string, part int, sign int, least int, ord int, pattern string, guard string, "
    "guard_scope string, guard_sign int, needs string, words array<string>, texts array<string>"
)
#: The index is broadcast up to this many (word, pattern) rows; a longer one is joined by a shuffle on the word.
BROADCAST_INDEX = 20_000
#: Parts that a rule may have: they are bits of a long.
MOST_PARTS = 60
#: The fact that a candidate names no other party.
ALONE = "no-other-party"


def rows_of(
    rule: str,
    patterns: Iterable[str],
    kind: str = "flag",
    topic: str | None = None,
    part: int = 0,
    sign: int = 1,
    least: int = 1,
    guard: str | None = None,
    guard_scope: str | None = None,
    guard_sign: int = 0,
    needs: str | None = None,
) -> list[tuple]:
    """Rows of one part of a rule; words and texts that its patterns require are read from them.

    ``kind`` is flag, hedge or cue (texts of kind candidate are read for
    flags, reports for the others). ``least`` matches are needed. A guard is a
    pattern that has to be there (``guard_sign`` 1) or must not be (-1) in the
    sentence of the match (``guard_scope`` sentence) or before the match in it
    (before).
    """
    return [
        (rule, kind, topic, part, sign, least, i, f"(?i){p}", guard and f"(?i){guard}", guard_scope, guard_sign, needs, required_words(p), required_texts(p))
        for i, p in enumerate(patterns)
    ]


def default_rows() -> list[tuple]:
    """The rules of ``rules_data`` as rows."""
    plain = {
        "no_contact": R.NO_CONTACT,
        "rear_ended": R.REAR_END,
        "emergency_response": R.EMERGENCY,
        "traffic_violation": R.TRAFFIC_VIOLATION,
        "lane_intrusion": R.LANE_INTRUSION,
        "automation_first": R.AUTOMATION_FIRST,
    }
    out = [row for rule, patterns in plain.items() for row in rows_of(rule, patterns)]
    out += rows_of("multi_contact", R.CONTACT_VERBS, least=R.MULTI_CONTACT)
    for rule, parts in {
        "handled_well": (R.BRAKED_TO_STOP, R.STOPPED_CONTACT),
        "not_struck": (R.NOT_DAMAGED, R.DAMAGE, R.TWO_OTHERS),
    }.items():
        out += [row for i, patterns in enumerate(parts) for row in rows_of(rule, patterns, part=i)]
    out += rows_of("infrastructure", R.INFRASTRUCTURE, needs=ALONE)
    out += rows_of("infrastructure", R.OTHER_ACTOR, part=1, sign=-1, needs=ALONE)
    for rule, sign in (("human_first", -1), ("human_untimed", 1)):
        out += rows_of(rule, R.HUMAN_CONTROL, guard=R.AFTER_CONTACT, guard_scope="before", guard_sign=sign)
    out += rows_of("occupant_action", R.OCCUPANT, guard=R.OTHER_OWNER, guard_scope="sentence", guard_sign=-1)
    out += rows_of("engaged", R.ENGAGED, kind="cue") + rows_of("not-engaged", R.NOT_ENGAGED, kind="cue")
    for i, (topic, patterns) in enumerate(R.HEDGES.items()):
        out += rows_of(f"hedge-{i}", patterns, kind="hedge", topic=topic)
    return out


def rule_table(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The default rules, and rows that a user adds (see :func:`rows_of`)."""
    return spark.createDataFrame([*default_rows(), *more], RULES)


def texts_of(candidates: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(candidate_id, ord, kind, text, facts): the narrative of each candidate, and those of its reports.

    ``ord`` is -1 for the candidate's own. ``reports`` holds candidate_id,
    ord and narrative; without it, the reports that candidates carry are read.
    Texts that are null are left out: no rule fires on them.
    """
    alone = F.col("crash_interaction_counterpart").isNull() | F.col("crash_interaction_counterpart").isin(*R.NO_OTHER_PARTY)
    none = F.array().cast("array<string>")
    own = F.struct(
        F.lit(-1).alias("ord"), F.lit("candidate").alias("kind"), F.col("narrative").alias("text"), F.when(alone, F.array(F.lit(ALONE))).otherwise(none).alias("facts")
    )
    said = lambda at, text: F.struct(at.cast("int").alias("ord"), F.lit("report").alias("kind"), text.alias("text"), none.alias("facts"))
    if reports is None:
        each = F.concat(F.array(own), F.transform("reports", lambda r, i: said(i, r["narrative"])))
        long = candidates.select("candidate_id", F.explode(each).alias("t")).select("candidate_id", "t.*")
    else:
        long = candidates.select("candidate_id", own.alias("t")).unionByName(
            reports.select("candidate_id", said(F.col("ord"), F.col("narrative")).alias("t"))
        ).select("candidate_id", "t.*")
    return long.filter(F.col("text").isNotNull())


def _guarded() -> Column:
    """Whether the guard of a match lets it count; without one, it does."""
    text, phrase, guard = F.col("text"), F.col("phrase"), F.col("guard")
    # The first sentence that holds the phrase; where a match spans several, the whole text for a guard of scope sentence.
    own = F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.contains(s, phrase)), F.lit(0))
    at = F.regexp_instr(own, guard)
    before = F.coalesce((at > 0) & (at < F.instr(own, phrase)), F.lit(False))
    there = F.when(F.col("guard_scope") == "before", before).otherwise(F.regexp_like(F.coalesce(own, text), guard))
    return F.when(guard.isNull(), F.lit(True)).otherwise(there == (F.col("guard_sign") > 0))


def fits_broadcast(rules: DataFrame) -> bool:
    """Whether the index of a rule table may be broadcast; a rule with too many parts is an error."""
    rows, part = rules.agg(F.sum(F.greatest(F.size("words"), F.lit(1))), F.max("part")).first()
    if (part or 0) >= MOST_PARTS:
        raise ValueError(f"a rule has more than {MOST_PARTS} parts")
    return (rows or 0) <= BROADCAST_INDEX


def rule_matches(texts: DataFrame, rules: DataFrame, small: bool | None = None) -> DataFrame:
    """(candidate_id, ord, rule, kind, topic, part, sign, least, nth, phrase, times, last, fits): patterns that occur in texts.

    Words of a text are looked up in an index of the words that patterns
    require; only patterns found there, and those that require no whole word,
    are tried, the latter only where the text holds what they require inside
    words. The index is broadcast if ``small``, which is found by a count of
    the rules where it is not given. Work grows with the words of the texts
    and with the rules that they can fire, not with texts times rules.
    """
    small = fits_broadcast(rules) if small is None else small
    size = F.size("words")
    index = rules.withColumn("word", F.explode(F.when(size > 0, F.col("words")).otherwise(F.array(F.lit("")))))
    index = index.withColumnRenamed("ord", "nth").withColumn("over", F.when(F.col("kind") == "flag", "candidate").otherwise("report"))
    if small:
        index = F.broadcast(index)
    words = F.array_append(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9_]+")), F.lit(""))
    each = texts.withColumnRenamed("kind", "over").withColumn("word", F.explode(F.array_distinct(words)))
    tried = each.join(index, ["word", "over"]).filter(
        (F.size("texts") == 0) | F.exists("texts", lambda t: F.contains(F.lower("text"), t))
    )
    tried = tried.filter(F.regexp_like("text", "pattern"))
    cue = F.col("kind") == "cue"
    upto = F.concat(F.lit(r"(?i)^([\s\S]*)(?:"), F.replace("pattern", F.lit("(?i)"), F.lit("")), F.lit(")"))
    found = tried.select(
        "candidate_id",
        "ord",
        "rule",
        "kind",
        "topic",
        "part",
        "sign",
        "least",
        "nth",
        "needs",
        "facts",
        "text",
        "pattern",
        "guard",
        "guard_scope",
        "guard_sign",
        F.call_function("regexp_extract", F.col("text"), F.col("pattern"), F.lit(0)).alias("phrase"),
        F.when(F.col("least") > 1, F.regexp_count("text", "pattern")).otherwise(1).alias("times"),
        # Characters before the last match.
        F.when(cue, F.length(F.call_function("regexp_extract", F.col("text"), upto, F.lit(1)))).alias("last"),
    )
    fits = _guarded() & (F.col("needs").isNull() | F.array_contains("facts", F.col("needs")))
    snippet = F.when(F.col("kind") == "hedge", _snippet())
    return found.withColumns({"fits": fits, "snippet": snippet}).drop("text", "pattern", "guard", "guard_scope", "guard_sign", "needs", "facts")


def _snippet(pad: int = 60) -> Column:
    """The match with up to ``pad`` characters on either side, widened to whole words."""
    text, at = F.col("text"), F.regexp_instr("text", "pattern")
    start, end = F.greatest(at - pad, F.lit(1)), at + F.length("phrase") + pad
    word = F.regexp_extract(F.substring(text, F.lit(1), start - 1), r"\S*\z", 0)
    rest = F.regexp_extract(F.substring(text, end, F.length(text)), r"\A\S*", 0)
    return F.trim(F.concat(word, F.substring(text, start, end - start), rest))


def fired(matches: DataFrame, rules: DataFrame, small: bool | None = None) -> DataFrame:
    """(candidate_id, ord, rule, kind, topic, phrase, snippet, last): rules that fire, one row for each text and rule.

    The phrase is that of the first pattern of the first part. One shuffle, by
    candidate, of the few patterns that occurred; all steps share it.
    """
    small = fits_broadcast(rules) if small is None else small
    key = ["candidate_id", "ord", "rule", "kind", "topic"]
    best = F.struct("nth", "fits", "phrase", "snippet")
    parts = (
        matches.repartition("candidate_id")
        .groupBy(*key, "part", "sign", "least")
        .agg(F.min(best).alias("best"), F.sum("times").alias("times"), F.max("last").alias("last"))
    )
    holds = (F.col("times") >= F.col("least")) & F.col("best.fits")
    bit = F.expr("shiftleft(1L, part)")
    on = lambda sign: F.bit_or(F.when(holds & (F.col("sign") == sign), bit).otherwise(F.lit(0).cast("long")))
    texts = parts.groupBy(*key).agg(
        on(1).alias("have"), on(-1).alias("bad"), F.min(F.struct("part", "best.phrase", "best.snippet")).alias("first"), F.max("last").alias("last")
    )
    want = rules.filter("sign = 1").select("rule", F.expr("shiftleft(1L, part)").alias("bit")).groupBy("rule").agg(F.bit_or("bit").alias("want"))
    return (
        texts.join(F.broadcast(want) if small else want, "rule")
        .filter((F.col("have") == F.col("want")) & (F.col("bad") == 0))
        .select(*key, "first.phrase", "first.snippet", "last")
    )


def rule_evidence(candidates: DataFrame, rules: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(candidate_id, flags, cues, hedge_list) of the candidates on which rules fire.

    ``flags`` are the names of fired rules, sorted; a cue is the engagement
    that a report says last (equal places settle nothing); hedges are in the
    order of reports and rules. A candidate's evidence is one row, a report's
    place in it is ``ord``.
    """
    return gathered(text_evidence(texts_of(candidates, reports), rules))


def report_texts(reports: DataFrame) -> DataFrame:
    """(candidate_id, ord, kind, text, facts): the narratives of reports as rows; ``ord`` is the report's own key, struct(generation, report_id)."""
    incident = identity_key(F.col("same_incident_id"), F.col("reporting_generation"), F.col("report_id"))
    own = F.struct(F.col("reporting_generation").alias("generation"), "report_id")
    none = F.array().cast("array<string>")
    return reports.select(
        incident.alias("candidate_id"), own.alias("ord"), F.lit("report").alias("kind"), F.col("narrative").alias("text"), none.alias("facts")
    ).filter(F.col("text").isNotNull())


def text_evidence(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(candidate_id, ord, flags, cue, hedges) of the texts on which rules fire; one row for each text."""
    small = fits_broadcast(rules)
    rows = fired(rule_matches(texts, rules, small), rules, small)
    cue = F.col("kind") == "cue"
    # Of the cues of a report, the one said last; a tie gives none.
    by_text = rows.groupBy("candidate_id", "ord").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "flag", F.col("rule")))).alias("flags"),
        F.reverse(F.array_sort(F.collect_list(F.when(cue, F.struct("last", F.col("rule").alias("value"), F.col("phrase").alias("text")))))).alias("said"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "hedge", F.struct("rule", "topic", "phrase", F.col("snippet").alias("text"))))).alias("hedges"),
    )
    top, next_ = F.get("said", F.lit(0)), F.get("said", F.lit(1))
    return by_text.withColumn("cue", F.when((F.size("said") > 0) & (next_.isNull() | (top["last"] > next_["last"])), top)).drop("said")


def gathered(by_text: DataFrame) -> DataFrame:
    """(candidate_id, flags, cues, hedge_list) of the texts of each candidate."""
    rows = by_text.select(
        "candidate_id",
        "flags",
        F.when(F.col("cue").isNotNull(), F.struct("ord", "cue.value", "cue.text")).alias("cue"),
        F.transform("hedges", lambda h: F.struct(F.col("ord").alias("ord"), h["rule"].alias("rule"), h["topic"].alias("topic"), h["phrase"].alias("phrase"), h["text"].alias("text"))).alias("hedges"),
    )
    return rows.groupBy("candidate_id").agg(
        F.array_sort(F.flatten(F.collect_list("flags"))).alias("flags"),
        F.array_sort(F.collect_list("cue")).alias("cues"),
        F.array_sort(F.flatten(F.collect_list("hedges"))).alias("hedge_list"),
    )


def with_rule_evidence(candidates: DataFrame, rules: DataFrame, reports: DataFrame | None = None, names: Iterable[str] = ()) -> DataFrame:
    """Candidates with the columns of :func:`evidence.report_cues` and :func:`evidence.narrative_flags`, from a rule table.

    ``names`` are the rules that become columns; by default those of ``default_rows``.
    """
    names = list(names) or sorted({r[0] for r in default_rows() if r[1] == "flag"})
    found = rule_evidence(candidates, rules, reports)
    out = candidates.join(found, "candidate_id", "left")
    keyed = lambda x, *fields: F.struct(
        F.get("reports", x["ord"])["reporting_generation"].alias("generation"),
        F.get("reports", x["ord"])["report_id"].alias("report_id"),
        *(x[f].alias(f) for f in fields),
    )
    empty = F.array()
    cues = F.transform(F.coalesce("cues", empty.cast("array<struct<ord:int,value:string,text:string>>")), lambda x: keyed(x, "value", "text"))
    hedges = F.transform(
        F.coalesce("hedge_list", empty.cast("array<struct<ord:int,rule:string,topic:string,phrase:string,text:string>>")),
        lambda x: keyed(x, "topic", "phrase", "text"),
    )
    flags = {n: F.coalesce(F.array_contains("flags", n), F.lit(False)) for n in names}
    return out.withColumns({**flags, "cues": cues, "hedge_list": hedges}).drop("flags")
