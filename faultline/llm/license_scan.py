"""Licence texts found by the digest of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .license_texts import DIGESTS, TEXTS

#: Equivalent spellings, replaced in this order in lower-cased text. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
)
#: A line that states a copyright, and one that says no more than a right reserved.
COPYRIGHT_LINE = r"(^|\n)[\x20\t]*(copyright|\(c\)|©)[^\n]*"
RESERVED_LINE = r"(^|\n)[\x20\t]*all rights reserved\.?[\x20\t\r]*"
#: What may stand before a line's first word: white space and comment marks.
_LEAD = r"(?:^|(?<=\n))[^\p{L}\p{N}\n(©]*"
#: A dated or marked notice as a line of its own.
NOTICE = rf"{_LEAD}(?:copyright\b[^\n]{{0,40}}?(?:\(c\)|©|\b[12][0-9]{{3}}\b)|\(c\)[\x20\t]*(?:copyright\b|[12][0-9]{{3}})|©)[^\n]*"
#: A notice without a date, in the first lines only; a clause that goes on after "copyright" is none.
_CLAUSE = r"(?:notice|holder|owner|law|licen[cs]e|statement|interest|disclaimer|permission|protect|and\b|or\b|in\b|of\b|to\b|the\b)"
HEAD_NOTICE = rf"\A((?:[^\n]*\n){{0,3}}?)[^\p{{L}}\p{{N}}\n(©]*copyright\b(?![^\p{{L}}\p{{N}}(©]*(?:{_CLAUSE}|\z))[^\n]*"
RESERVED = rf"{_LEAD}all rights reserved[^\p{{L}}\p{{N}}\n]*(?=\n|\z)"


def canonical(text: Column) -> Column:
    """Lower case, one spelling, no copyright lines, words of letters and digits with one space between."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT_LINE, "\n")
    c = F.regexp_replace(c, RESERVED_LINE, "\n")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def unwrapped(text: Column) -> Column:
    """The canonical form of a text whose line breaks and comment marks say nothing: notices go, then lines are joined."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), NOTICE, "")
    c = F.regexp_replace(c, HEAD_NOTICE, "$1")
    c = F.regexp_replace(c, RESERVED, "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n[^\p{L}\p{N}\n]*", " "), r"\s+", " ")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


#: Words without which no text is taken for a licence beyond its canonical form. Fixed values.
LICENSE_WORD = r"(?i)licen[cs]e|permission|redistribut|public domain|warrant"
#: What frames a licence, in its unwrapped form: titles in front, the names of holders and list marks. Fixed values.
TITLE = (
    r"^(?:(?:the )?(?:(?:mit|isc|zlib|x11|expat|unlicense|apache|bsd|new|modified|revised|simplified|freebsd|0bsd|zero|no attribution|clause|style|or|[0-9]) ){1,6}license"
    r"(?: (?:mit|isc|zlib|x11|expat|0bsd|bsd|clause|[0-9]))*(?: |$))+"
)
HOLDER = (
    (r"neither the names? of .{1,120}? nor the names? of (?:its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by .{1,120}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall .{1,120}? be liable for any direct indirect", "in no event shall the copyright holder or contributors be liable for any direct indirect"),
)
LIST_MARK = r"(?<= )(?:[0-9]|i{1,3}|iv|[a-e]|o) (?=redistributions (?:of|in)|neither the|the origin of|altered source|this notice may)"
#: A holder's line that goes on: words between the notice and the licence's own first words.
HOLDER_LINES = r"^(?:[\p{L}\p{N}]+ ){0,12}?(?=permission is hereby granted|permission to use copy modify|redistribution and use in source)"


def unframed(form: Column) -> Column:
    """An unwrapped form without title, holder's names and list marks, so that the usual frames of one licence are equal."""
    c = F.regexp_replace(form, TITLE, "")
    c = F.regexp_replace(c, HOLDER_LINES, "")
    for pattern, plain in HOLDER:
        c = F.regexp_replace(c, pattern, plain)
    return F.trim(F.regexp_replace(c, LIST_MARK, ""))


def known_licenses(spark, texts: dict[str, str] = TEXTS, digests: tuple = DIGESTS) -> DataFrame:
    """(canonical_sha256, license_id, unwrapped_sha256, unframed_sha256) of known texts; of equal canonical texts the first id stays.

    Licences of which only digests of the unwrapped form are known (whole, and
    without what follows the terms) have a null canonical_sha256. Without
    texts and digests the table is empty.
    """
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    form = unwrapped(F.col("text"))
    short = (
        rows.select(
            "license_id",
            F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"),
            F.struct(F.sha2(form, 256).alias("u"), F.sha2(unframed(form), 256).alias("f")).alias("more"),
        )
        .groupBy("canonical_sha256")
        .agg(F.min("license_id").alias("license_id"), F.min_by("more", "license_id").alias("more"))
        .select("canonical_sha256", "license_id", F.col("more.u").alias("unwrapped_sha256"), F.col("more.f").alias("unframed_sha256"))
    )
    long = spark.createDataFrame([(i, d, d) for i, d in digests], "license_id string, unwrapped_sha256 string, unframed_sha256 string")
    return short.unionByName(long.withColumn("canonical_sha256", F.lit(None).cast("string")))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Licence of every whole text: doc_id, canonical_sha256, license_id (null: none).

    A text is a known licence when the canonical forms have the same SHA-256,
    or else the unwrapped ones, or else the unframed ones, where ``known`` has
    unwrapped_sha256 and unframed_sha256. The latter two are made only of
    texts that hold a word without which there is no licence. A null text is
    empty and no licence; repeated rows give repeated results; other columns
    are ignored; an empty table gives no rows. The table of known digests
    joins by hash; Spark broadcasts it while it is small.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    more = [c for c in ("unwrapped_sha256", "unframed_sha256") if c in known.columns]
    rows = docs.select("doc_id", "text")
    if more:
        likely = F.regexp_like("text", F.lit(LICENSE_WORD))
        rows = rows.withColumn("form", F.when(likely, unwrapped(F.col("text"))))
    made = {"unwrapped_sha256": lambda: F.col("form"), "unframed_sha256": lambda: unframed(F.col("form"))}
    # Written once, so that no later plan of a join reads the texts again.
    digests = stored(
        rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), *(F.sha2(made[c](), 256).alias(c) for c in more))
    )
    out = digests.join(known.filter("canonical_sha256 is not null").select("canonical_sha256", "license_id"), "canonical_sha256", "left")
    for i, c in enumerate(more):
        other = known.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("license_id").alias(f"other_{i}"))
        out = out.join(other, c, "left")
    return out.select("doc_id", "canonical_sha256", F.coalesce("license_id", *(f"other_{i}" for i in range(len(more)))).alias("license_id"))
