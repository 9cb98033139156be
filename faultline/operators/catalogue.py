"""Catalogue queries: lists, pages, counts, facets and the bounded map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.dates import partial_date_sort_key
from ..functions.text import url_lines

PAGE_SIZE = 50
MAP_CAP = 1000
VALENCES = ("failure-or-challenging", "successful-handling", "neutral-or-unclear")


def public_only(events: DataFrame) -> DataFrame:
    return events.filter("is_public")


def by_origin(events: DataFrame, origin: str) -> DataFrame:
    return events.filter(F.col("origin") == origin)


def by_status(submissions: DataFrame, status: str) -> DataFrame:
    return submissions.filter(F.col("status") == status)


def nested_sources(sources: DataFrame, key: str = "event_slug") -> DataFrame:
    """(key, sources): the sources of each event as one sorted array. An event's sources are part of its record."""
    rest = [c for c in ("source_type", "external_record_id", "url") if c in sources.columns]
    rest += [c for c in sources.columns if c not in (key, *rest)]
    return sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("sources"))


def read_corpus(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with their sources nested; none gives an empty array."""
    own = nested_sources(sources)
    out = events.join(own, events["slug"] == own["event_slug"], "left").drop("event_slug")
    return out.withColumn("sources", F.coalesce("sources", F.array().cast(own.schema["sources"].dataType)))


def source_count(events: DataFrame, sources: DataFrame) -> DataFrame:
    n = sources.groupBy(F.col("event_slug").alias("slug")).agg(F.count(F.lit(1)).alias("source_count"))
    return events.join(n, "slug", "left").na.fill(0, ["source_count"])


def event_summary(corpus: DataFrame) -> DataFrame:
    cols = ("slug", "title", "occurred_on", "occurred_on_precision", "developer_or_operator", "system_name", "event_type", "valence", "review_status", "origin")
    n = F.col("source_count") if "source_count" in corpus.columns else F.size("sources").cast("long")
    return corpus.select(*cols, n.alias("source_count"))


def newest_first():
    """Order of lists: date key descending, title in locale order, slug last so that the order is total."""
    key = partial_date_sort_key(F.col("occurred_on"), F.col("occurred_on_precision"))
    return [key.desc(), F.collate("title", "UNICODE").asc(), F.col("slug").asc()]


def seek_page(df: DataFrame, after: tuple | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The next ``size`` rows of :func:`newest_first` after a known row, given as (date key, title, slug).

    The predicate is the order itself, lexicographic, with collated titles and
    null titles first; only rows behind the known one are sorted, and of
    those each task keeps a page.
    """
    if after is None:
        return df.orderBy(*newest_first()).limit(size)
    key = partial_date_sort_key(F.col("occurred_on"), F.col("occurred_on_precision"))
    date, title, slug = (F.lit(x) for x in after)
    mine = F.collate("title", "UNICODE")
    later_slug = F.col("slug") > slug
    if after[1] is None:
        in_date = F.col("title").isNotNull() | later_slug
    else:
        there = F.collate(title.cast("string"), "UNICODE")
        in_date = (mine > there) | ((mine == there) & later_slug)
    behind = (key < date) | ((key == date) & in_date)
    return df.filter(behind).orderBy(*newest_first()).limit(size)


@dataclass(frozen=True)
class PageDirectory:
    """A list written in order: ``starts`` holds (part, rows before it, rows in it) of each range partition."""

    path: str
    starts: tuple[tuple[int, int, int], ...]
    schema: StructType

    @property
    def rows(self) -> int:
        return self.starts[-1][1] + self.starts[-1][2] if self.starts else 0

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with ``row``: the place of each, from 0."""
        stored = StructType([*self.schema.fields, StructField("_at", LongType()), StructField("_part", IntegerType())])
        before = spark.createDataFrame([s[:2] for s in self.starts], "_part int, _before long")
        rows = spark.read.schema(stored).parquet(self.path).join(F.broadcast(before), "_part")
        return rows.select(*self.schema.names, (F.col("_before") + F.col("_at")).alias("row"))

    def page(self, spark: SparkSession, number, size: int = PAGE_SIZE) -> tuple[DataFrame, dict]:
        """As :func:`page`, but reading only the parts that hold the page, and of those only row groups with its rows."""
        pages = max(1, -(-self.rows // size))
        n = min(page_number(number), pages)
        low, high = (n - 1) * size, n * size
        stored = StructType([*self.schema.fields, StructField("_at", LongType()), StructField("_part", IntegerType())])
        rows = spark.read.schema(stored).parquet(self.path)
        wanted = F.lit(False)
        for part, before, held in self.starts:
            if before < high and before + held > low:
                wanted = wanted | ((F.col("_part") == part) & F.col("_at").between(low - before, high - before - 1))
        found = rows.filter(wanted).orderBy("_part", "_at").select(*self.schema.names)
        return found, {"matched": self.rows, "page": n, "pages": pages}


def page_directory(df: DataFrame, path: str, order=None) -> PageDirectory:
    """Write ``df`` to ``path`` in order, by ranges, so that any page is read from the parts that hold it.

    One shuffle by ranges of the order. Each range is a folder, sorted, its
    rows numbered; the driver sees one count for each range.
    """
    order = order or newest_first()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    placed = ranged.withColumn("_row", row).withColumns(
        {"_at": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)), "_part": F.shiftright("_row", 33).cast("int")}
    )
    placed.drop("_row").write.partitionBy("_part").parquet(path)
    stored = StructType([*df.schema.fields, StructField("_at", LongType()), StructField("_part", IntegerType())])
    counts = df.sparkSession.read.schema(stored).parquet(path).groupBy("_part").count().orderBy("_part").collect()
    starts, before = [], 0
    for part, held in counts:
        starts.append((part, before, held))
        before += held
    return PageDirectory(path, tuple(starts), df.schema)


def keyset_page(df: DataFrame, key: str, after=None, size: int = PAGE_SIZE) -> DataFrame:
    """The next ``size`` rows by a unique key after a known one. A page costs the same however deep it lies."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def keyset_scan(df: DataFrame, key: str, size: int = PAGE_SIZE) -> DataFrame:
    """All rows with ``page``, by a unique key: each page but the last has ``size`` rows, none is left out or comes twice.

    One shuffle by ranges of the key; the driver sees one count for each
    partition. The ranges are kept (spilling to disk), so the counts and the
    rows are of one and the same split.
    """
    cols = df.columns
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_row", F.monotonically_increasing_id())
    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_row", 33)
    before, upto = [], 0
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], upto))
        upto += r["count"]
    start = df.sparkSession.createDataFrame(before, "_part long, _before long")
    at = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = ranged.withColumn("_part", part).join(F.broadcast(start), "_part")
    return rows.select(*cols, (F.floor(at / size) + 1).alias("page"))


def select_imports(records: DataFrame, collection: str | None = None) -> DataFrame:
    """Manifest records that are to be imported, of one collection if it is named."""
    out = records.filter("decision = 'import'")
    return out if collection is None else out.filter(F.col("collection") == collection)


def page_number(number) -> int:
    """The page asked for; what is no number of 1 or more is page 1."""
    text = str(number)
    return int(text) if text.isdigit() and int(text) >= 1 else 1


def page(df: DataFrame, number, size: int = PAGE_SIZE, order=None) -> tuple[DataFrame, dict]:
    """Rows of one page, and {matched, page, pages}. Pages start at 1; a bad number is page 1, a high one the last page."""
    matched = df.count()
    pages = max(1, -(-matched // size))
    n = min(page_number(number), pages)
    rows = df.orderBy(*(order or newest_first())).offset((n - 1) * size).limit(size)
    return rows, {"matched": matched, "page": n, "pages": pages}


def capped(df: DataFrame, cap: int = MAP_CAP) -> DataFrame:
    """At most ``cap`` rows by slug, each with the count of all."""
    return df.orderBy("slug").limit(cap).withColumn("matched", F.lit(df.count()))


def valence_stats(events: DataFrame) -> DataFrame:
    """One row: total and the count of each valence, zeros kept."""
    return events.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("valence") == v).alias(v.replace("-", "_")) for v in VALENCES)
    )


def queue_order(submissions: DataFrame) -> DataFrame:
    """Submissions by newest date, then creation, then id."""
    return submissions.orderBy(F.col("event_date").desc_nulls_last(), F.col("created_at").desc(), "id")


def submission_summary(submissions: DataFrame) -> DataFrame:
    """Inbox rows: flags instead of private text, and how many further URLs come along."""
    return submissions.select(
        "id",
        "evidence_url",
        "status",
        "event_date",
        F.col("what_happened").isNotNull().alias("has_text"),
        F.col("submitter_email").isNotNull().alias("has_email"),
        F.coalesce(F.size(url_lines(F.col("additional_urls"))), F.lit(0)).alias("extra_urls"),
    )


def to_geojson_features(points: DataFrame) -> DataFrame:
    """(slug, feature): each point as a GeoJSON feature."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    rest = F.struct("slug", "event_type", "valence", "developer_or_operator", "resolved_level")
    return points.select(
        "slug", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), rest.alias("properties"))).alias("feature")
    )
