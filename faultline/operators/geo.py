"""Places: lookup tables, resolution with fallback, and audits of what resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import location_tokens
from .places_data import CITIES, COUNTRIES, OVERRIDES, REGIONS

LOOKUP_SCHEMA = "key string, level string, country_code string, region_code string, city_name string, latitude double, longitude double, display_name string"
OVERRIDE_SCHEMA = "location_text string, location_country_code string, lookup_key string, rationale string"


def _places() -> list[tuple]:
    """Lookup rows with their keys: upper-case parts joined by a bar."""
    names = {c: name for c, _, _, name in COUNTRIES}
    rows = [(c, "country", c, None, None, la, lo, name) for c, la, lo, name in COUNTRIES]
    rows += [(f"{r}|{c}", "region", c, r, None, la, lo, f"{name}, {c}") for r, c, la, lo, name in REGIONS]
    for city, r, c, la, lo in CITIES:
        key = "|".join(x for x in (city.upper(), r, c) if x)
        rows.append((key, "city", c, r, city.upper(), la, lo, f"{city}, {r}, {c}" if r else f"{city}, {names[c]}"))
    return rows


PLACES = _places()


def lookup(spark: SparkSession, rows=PLACES) -> DataFrame:
    return spark.createDataFrame(rows, LOOKUP_SCHEMA)


def overrides(spark: SparkSession, rows=OVERRIDES) -> DataFrame:
    return spark.createDataFrame(list(rows), OVERRIDE_SCHEMA)


def load_reference_data(rows: DataFrame) -> DataFrame:
    """Lookup rows with their key made of upper-case parts; a key that comes twice is an error."""
    part = lambda c: F.upper(F.trim(c))
    keyed = rows.withColumn("key", F.concat_ws("|", part("city_name"), part("region_code"), part("country_code")))
    twice = keyed.groupBy("key").count().filter("`count` > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate lookup keys: {sorted(r['key'] for r in twice)}")
    return keyed


POINT = ("slug", "event_type", "valence", "developer_or_operator", "latitude", "longitude", "resolved_level")


def resolve_override(events: DataFrame, override: DataFrame, places: DataFrame) -> DataFrame:
    """Public curated events placed by their stated text and country, nulls equal; an override without a key places nothing.

    The join keys are made null-safe as columns, so Spark joins by hash and
    broadcasts the override table while it is small.
    """
    e = events.filter("is_public and origin = 'curated'")
    o = override.select(F.col("location_text").alias("o_text"), F.col("location_country_code").alias("o_country"), F.col("lookup_key").alias("key"))
    placed = e.join(o, F.col("location_text").eqNullSafe(F.col("o_text")) & F.col("location_country_code").eqNullSafe(F.col("o_country")))
    return placed.join(places.select("key", "latitude", "longitude", F.col("level").alias("resolved_level")), "key").select(*POINT)


def resolve_hierarchical(events: DataFrame, places: DataFrame) -> DataFrame:
    """Public derived events placed by city, else region, else country of their place text; none gives no row."""
    city, region = location_tokens(F.col("location_text"))
    e = events.filter("is_public and origin = 'source-derived' and location_text is not null").select(
        *POINT[:4],
        city.alias("city_token"),
        region.alias("region_token"),
        F.upper("location_country_code").alias("country_token"),
    )
    keys = {
        "city": F.concat("city_token", F.lit("|"), "region_token", F.lit("|"), "country_token"),
        "region": F.concat("region_token", F.lit("|"), "country_token"),
        "country": F.col("country_token"),
    }
    for level, key in keys.items():
        own = places.filter(F.col("level") == level).select(
            F.col("key").alias(f"{level}_key"), F.struct("latitude", "longitude", "level").alias(level)
        )
        e = e.withColumn(f"{level}_key", key).join(own, f"{level}_key", "left")
    hit = F.coalesce("city", "region", "country")
    return e.withColumn("hit", hit).filter("hit is not null").select(
        *POINT[:4],
        F.col("hit.latitude").alias("latitude"),
        F.col("hit.longitude").alias("longitude"),
        F.col("hit.level").alias("resolved_level"),
    )


def event_map(events: DataFrame, override: DataFrame, places: DataFrame) -> DataFrame:
    """All placed public events: the union of both ways to place one."""
    return resolve_override(events, override, places).unionByName(resolve_hierarchical(events, places))


def resolution_report(events: DataFrame, points: DataFrame) -> DataFrame:
    """Public events by origin: placed at each level, not placed, and placed coarser than their text states."""
    e = events.filter("is_public").select("slug", "origin", "location_precision")
    joined = e.join(points.select("slug", "resolved_level"), "slug", "left")
    coarser = (F.col("location_precision") == "city") & F.col("resolved_level").isin("region", "country") | (
        F.col("location_precision") == "region"
    ) & (F.col("resolved_level") == "country")
    levels = ("city", "region", "country")
    return joined.groupBy("origin").agg(
        *(F.count_if(F.col("resolved_level") == v).alias(v) for v in levels),
        F.count_if(F.col("resolved_level").isNull()).alias("unmapped"),
        F.count_if(F.coalesce(coarser, F.lit(False))).alias("coarser_than_stated"),
    )


def before_after(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(value, before, after, changed): counts of a column's values in two snapshots, and rows that left each value."""
    b = before.select(key, F.col(column).alias("b"))
    a = after.select(key, F.col(column).alias("a"))
    both = b.join(a, key, "full_outer")
    sides = both.select(F.explode(F.array(F.struct(F.col("b").alias("value"), F.lit(1).alias("nb"), F.lit(0).alias("na"), (~F.col("a").eqNullSafe(F.col("b"))).cast("int").alias("ch")), F.struct(F.col("a").alias("value"), F.lit(0).alias("nb"), F.lit(1).alias("na"), F.lit(0).alias("ch")))).alias("s")).select("s.*")
    return sides.filter("value is not null").groupBy("value").agg(F.sum("nb").alias("before"), F.sum("na").alias("after"), F.sum("ch").alias("changed"))


#: Keys of places in a box that go into the scan of the events; with more of them, only the joins decide.
PUSHED_KEYS = 5_000


def event_map_in(events: DataFrame, override: DataFrame, places: DataFrame, *box: float) -> DataFrame:
    """:func:`event_map` inside a box: the rows that ``filter_bounds`` leaves of it, found from the places in the box.

    The box filters the places first. Overrides are joined with those alone.
    For derived events the keys of these places, one of which an event must
    have on some level, are a filter of the scan, so few events reach the
    joins; the joins then see to it that no finer level has a place elsewhere.
    """
    inside = filter_bounds(places, *box)
    o = override.join(inside.select(F.col("key").alias("lookup_key")), "lookup_key", "left_semi")
    curated = resolve_override(events, o, inside)
    keys = [r["key"] for r in inside.select("key").limit(PUSHED_KEYS + 1).collect()]
    if len(keys) <= PUSHED_KEYS:
        city, region = location_tokens(F.col("location_text"))
        country = F.upper("location_country_code")
        ladder = (F.concat_ws("|", city, region, country), F.concat_ws("|", region, country), country)
        reach = F.lit(False)
        for k in ladder:
            reach = reach | k.isin(keys)
        events = events.filter(F.coalesce(reach, F.lit(False)))
    return curated.unionByName(filter_bounds(resolve_hierarchical(events, places), *box))


def filter_bounds(points: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Points inside a box, edges included. A box that is not finite, inverted, out of range or over the antimeridian is an error."""
    box = (min_lat, max_lat, min_lon, max_lon)
    if any(x != x for x in box):
        raise ValueError("bounds must be finite numbers")
    if min_lat > max_lat or min_lon > max_lon:
        raise ValueError("bounds are inverted or cross the antimeridian")
    if min_lat < -90 or max_lat > 90 or min_lon < -180 or max_lon > 180:
        raise ValueError("bounds are out of range")
    return points.filter(F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon))
