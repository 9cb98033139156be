"""Column expressions over text: trimming, folding, slugs, URLs, places, sentences."""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import required_texts

#: White space of Unicode. Fixed values.
WHITE = "\t\n\x0B\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Letters with marks and their plain forms, for folding without a normalization built-in. Fixed values.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorsstuuuzzz"


def trim_or_null(c: Column) -> Column:
    """Text without white space at either end; blank text is null.

    A text whose first and last bytes are visible ASCII has nothing to trim, and is not read through.
    """
    b = c.cast("binary")
    visible = lambda at: F.substring(b, at, 1).between(F.lit(b"!"), F.lit(b"~"))
    return F.when(visible(1) & visible(-1), c).otherwise(F.nullif(F.btrim(c, F.lit(WHITE)), F.lit("")))


def fold_name(c: Column) -> Column:
    """Key under which names differ by case, hyphens, points, commas and spaces only."""
    spaced = F.regexp_replace(F.lower(c), r"[-.,]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def fold_text(c: Column) -> Column:
    """Key under which texts differ by case, spaces, and points and commas that are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,]", ""), r"\s+", " "))


def normalize_url(c: Column) -> Column:
    """A URL without scheme, ``www.``, query, fragment and closing slashes, in lower case."""
    steps = ((r"^https?://", ""), (r"^www\.", ""), (r"[?#].*$", ""), (r"/+$", ""))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(c))


def slugify(c: Column) -> Column:
    """Lower case, runs of other characters as one dash, no dash at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slug_base(c: Column) -> Column:
    """A title as a slug of any length: marks folded, possessives and apostrophes dropped, no leading article."""
    plain = F.translate(F.lower(c), MARKED, PLAIN)
    plain = F.regexp_replace(plain, r"([a-z0-9])['’`´]s\b", "$1")
    plain = F.regexp_replace(plain, r"['’`´]", "")
    return F.regexp_replace(slugify(plain), r"^(?:a|an|the)-", "")


def slug_from_title(c: Column, most: int = 80, least: int = 24) -> Column:
    """struct(slug, method) of a title.

    A slug above ``most`` characters becomes the longest one, of at least
    ``least`` characters, of a prefix of the title that ends at a clause mark;
    failing that it is cut at its last dash. A title of any length is read
    only as far as its slug can depend on it: of two letters or digits, at
    least one stays in the slug.
    """
    kept = f"A-Za-z0-9{MARKED}{MARKED.upper()}"
    head = F.regexp_extract(c, rf"^(?:[^{kept}]*[{kept}]){{0,{2 * most + 40}}}[^{kept}]?", 0)
    # As an element of an array, the head is made once for all that is asked of it.
    return F.get(F.transform(F.array(head), lambda t: _slug_of_head(t, most, least)), F.lit(0))


def _slug_of_head(c: Column, most: int, least: int) -> Column:
    full = slug_base(c)
    # Prefixes that end before a clause mark: , ; : or dashes, or a point at the end of a sentence.
    ends = F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1)))
    marked = F.filter(
        ends,
        lambda i: F.regexp_like(F.substring(c, i + 1, F.lit(1)), F.lit(r"[;:,–—]"))
        | ((F.substring(c, i + 1, F.lit(1)) == ".") & F.regexp_like(F.substring(c, i + 2, F.lit(1)), F.lit(r"^\s?$"))),
    )
    clauses = F.transform(marked, lambda i: slug_base(F.substring(c, F.lit(1), i)))
    fitting = F.filter(clauses, lambda s: F.length(s).between(least, most))
    best = F.array_max(F.transform(fitting, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    cut = F.regexp_extract(full, rf"^(.{{1,{most - 1}}})-", 1)
    word = F.when(cut == "", F.substring(full, 1, most)).otherwise(F.regexp_replace(cut, "-+$", ""))
    return (
        F.when(F.length(full) <= most, F.struct(full.alias("slug"), F.lit("full").alias("method")))
        .when(best.isNotNull(), F.struct(best.alias("slug"), F.lit("clause-cut").alias("method")))
        .otherwise(F.struct(word.alias("slug"), F.lit("word-truncated").alias("method")))
    )


def hash_slug(prefix: str, key: Column, digits: int = 8) -> Column:
    """``prefix`` and the first digits of the key's MD5. Eight are shared by two of some 77,000 keys as likely as not."""
    return F.concat(F.lit(prefix), F.substring(F.md5(key.cast("binary")), 1, digits))


def event_slug(candidate_id: Column) -> Column:
    """The slug of a candidate's event: all 32 digits, so that no two incidents share one; it depends on the candidate alone."""
    return hash_slug("nhtsa-", candidate_id, 32)


def identity_key(incident: Column, generation: Column, report: Column) -> Column:
    """Key of an incident, or of a report that names none; never null for a report with an id."""
    return F.coalesce(
        F.concat(F.lit("same-incident:"), incident), F.concat_ws(":", F.lit("singleton"), generation, report)
    )


def external_record_id(generation: Column, report: Column) -> Column:
    return F.concat(generation, F.lit(":"), report)


def split_external_id(c: Column) -> tuple[Column, Column]:
    """Generation and report id, split at the first colon."""
    return F.substring_index(c, ":", 1), F.substring(c, F.instr(c, F.lit(":")) + 1, F.length(c))


def location_text(*parts: Column) -> Column:
    """Non-empty parts joined by commas; null without any."""
    return F.nullif(F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def location_tokens(c: Column) -> tuple[Column, Column]:
    """City and region tokens of a place text: the first two of three or more parts, or the first of two as region."""
    part = lambda n: F.upper(F.trim(F.split_part(c, F.lit(","), F.lit(n))))
    three, two = c.like("%,%,%"), c.like("%,%")
    return F.when(three, part(1)), F.when(three, part(2)).when(two, part(1))


def url_lines(c: Column) -> Column:
    """Non-blank lines of a text as array of struct(text, href); href is null unless the line is an http(s) URL alone."""
    lines = F.transform(F.split(c, r"\r?\n"), trim_or_null)
    return F.transform(
        F.filter(lines, lambda x: x.isNotNull()),
        lambda x: F.struct(x.alias("text"), F.when(F.regexp_like(x, F.lit(r"^https?://\S+$")), x).alias("href")),
    )


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def any_of(patterns: tuple[str, ...]) -> str:
    """One case-free pattern for several."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def present(kind: str, *items: tuple[Column, Column]) -> Column:
    """Array of the items, (condition, value), whose condition holds; ``kind`` is the type of a value.

    Joined arrays are compiled; an array whose nulls a lambda filters out would be interpreted, and all that goes into it.
    """
    none = F.array().cast(f"array<{kind}>")
    return F.concat(*(F.when(F.coalesce(c, F.lit(False)), F.array(v)).otherwise(none) for c, v in items))


#: Letters from rare to frequent in English. A text is sought by its first byte, so one that starts with a rare letter is sought faster.
RARE = "zqxjkvbgpwyfmcuhldrsnioate"
LEAST = 4


def _rarest_start(t: str) -> str:
    """The end of a text, of at least four characters, that starts with its rarest letter; the longest of several."""
    starts = range(max(len(t) - LEAST, 0) + 1)
    return t[min(starts, key=lambda i: (RARE.find(t[i]) if t[i] in RARE else len(RARE), i)) :]


@cache
def needed_texts(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Lower-case texts of which a match of any pattern holds one; empty where that can't be told."""
    each = [required_texts(p) for p in patterns]
    texts = {_rarest_start(t) for ts in each for t in ts} if all(each) else set()
    return tuple(sorted(t for t in texts if not any(u != t and u in t for u in texts)))


def may_match(c: Column, patterns: tuple[str, ...]) -> Column | None:
    """Whether a text holds what some pattern cannot match without, which is far cheaper to see than a match; None where that can't be told."""
    texts = needed_texts(patterns)
    return reduce(or_, (F.contains(F.lower(c), F.lit(t)) for t in texts)) if texts else None


def where_needed(c: Column, patterns: tuple[str, ...], found: Column, none: Column) -> Column:
    """``found``, sought only in texts that may match; ``none`` for the others and for null."""
    may = may_match(c, patterns)
    return F.coalesce(found, none) if may is None else F.when(may, found).otherwise(none)


def matches(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether some pattern occurs; false for null."""
    return where_needed(c, patterns, F.regexp_like(c, F.lit(any_of(patterns))), F.lit(False))


def first_match(c: Column, patterns: tuple[str, ...]) -> Column:
    """Text of the first pattern, in the order of the list, that occurs; null if none does."""
    none = F.lit(None).cast("string")
    each = lambda p: F.nullif(F.regexp_extract(c, f"(?i){p}", 0), F.lit(""))
    return F.coalesce(*(where_needed(c, (p,), each(p), none) for p in patterns))


def last_start(c: Column, patterns: tuple[str, ...]) -> Column:
    """Characters before the last match of any pattern. Ask only where one matches."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.length(F.regexp_extract(c, rf"(?i)^((?s:.*))(?:{joined})", 1))


def context_snippet(c: Column, pattern: str, pad: int = 60) -> Column:
    """The first match with up to ``pad`` characters on either side, widened to whole words; empty without a match."""
    p = f"(?i){pattern}"
    found, at = F.regexp_extract(c, p, 0), F.regexp_instr(c, F.lit(p))
    start, end = F.greatest(at - pad, F.lit(1)), at + F.length(found) + pad
    word = F.regexp_extract(F.substring(c, F.lit(1), start - 1), r"\S*\z", 0)
    rest = F.regexp_extract(F.substring(c, end, F.length(c)), r"\A\S*", 0)
    return F.when(at > 0, F.trim(F.concat(word, F.substring(c, start, end - start), rest))).otherwise(F.substring(c, 1, 0))
