"""Fixture views over the test tables. Both Spark SQL and DuckDB run them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate, evidence, geo
from ..operators import events as ev
from ..sources import io
from . import pipelines

#: Sentences of our own; each rule of the evidence fires on some and not on others. None: no narrative.
NARRATIVES = (
    "The Level 4 ADS was engaged. A pickup truck made contact with the rear of the Waymo AV.",
    "The test driver disengaged L3 ADS. The AV made contact with a curb.",
    "GM is submitting a duplicate report solely to avoid doubt under the Standing General Order and has not investigated the alleged incident.",
    "A car ran a red light and entered the AV's lane of travel.",
    "Following the contact, the safety driver assumed control of the vehicle.",
    "The teleoperator took over and the AV made contact with a fence.",
    "A passenger in the Waymo AV then opened the rear driver side door.",
    "A sedan struck a van, the van collided with a bus, and the bus rear-ended the AV.",
    "The AV made no contact with the debris. It may have slowed.",
    "The AV was traveling in autonomous mode, braked and came to a stop. A cyclist made contact with the stopped AV.",
    "The driver took manual control, then the ADS was engaged in autonomous mode.",
    None,
    "A fire engine with lights and sirens was responding to a call and made contact with the AV.",
    "The AV slowed for debris and did not touch it. A passenger vehicle behind met another passenger vehicle, which sustained damage.",
    "The ADS began a lane change and the driver took over before the AV made contact with a pole.",
    "The rider alleged minor injury after the AV stopped.",
    "The other driver reportedly left. It is not clear which lane they were in.",
    "A deer ran out; the AV braked and reduced speed.",
    "The AV was in manual mode when it made a left turn.",
    "A passenger in the other vehicle opened the rear left door.",
    "The operator became aware of the event and began a review. The ADS was not engaged.",
    "A sedan crossed the double yellow line and entered the AV's lane.",
    "A pickup truck struck the stopped AV near a planter.",
    "The AV, operating in autonomous mode, made contact with a gate.",
)
N_NARRATIVES = len(NARRATIVES)
NARRATIVE_CASES = " ".join(
    "WHEN {} THEN '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(NARRATIVES) if t
)

RAW_REPORTS = f"""
WITH n AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, o_orderdate, s_name, s_nationkey,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)
SELECT
  CASE WHEN l_orderkey % 2 = 0 THEN 'historical' ELSE 'current' END AS generation,
  l_orderkey * 100 + seq AS src_ord,
  CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey % 2 AS STRING) AS report_id,
  CASE WHEN seq = 9 THEN 'draft' WHEN seq = 8 THEN '99999999999999999999' ELSE CAST(seq AS STRING) END AS report_version,
  CASE WHEN l_suppkey % 40 = 0 THEN 'No New or Updated Incident Reports' ELSE 'Incident' END AS report_type,
  CASE WHEN l_orderkey % 50 < 2 THEN ' ' ELSE 'I' || CAST(l_orderkey - l_orderkey % 2 AS STRING) END AS same_incident_id,
  s_name AS reporting_entity,
  CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Kodiak Robotics,Inc.' WHEN 2 THEN 'Kodiak-Robotics, Inc'
       WHEN 3 THEN 'Waymo LLC' WHEN 4 THEN 'WAYMO LLC' ELSE 'Zoox' END AS operating_entity,
  CASE WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 19 = 0 THEN 'SOON' ELSE
    CASE month(o_orderdate) WHEN 1 THEN 'JAN' WHEN 2 THEN 'FEB' WHEN 3 THEN 'MAR' WHEN 4 THEN 'APR'
      WHEN 5 THEN 'MAY' WHEN 6 THEN 'JUN' WHEN 7 THEN 'JUL' WHEN 8 THEN 'AUG' WHEN 9 THEN 'SEP'
      WHEN 10 THEN 'OCT' WHEN 11 THEN 'NOV' ELSE 'DEC' END || '-' || CAST(year(o_orderdate) AS STRING) END AS incident_date,
  CASE s_nationkey % 5 WHEN 0 THEN 'Phoenix' WHEN 1 THEN 'San Francisco' WHEN 2 THEN 'San Fancisco'
       WHEN 3 THEN 'Kingwood' ELSE NULL END AS city,
  CASE s_nationkey % 5 WHEN 0 THEN 'AZ' WHEN 3 THEN 'TX' ELSE 'CA' END AS state,
  CASE l_suppkey % 5 WHEN 0 THEN 'Verified Engaged' WHEN 1 THEN 'Verified Not Engaged' WHEN 2 THEN 'Alleged Engaged'
       WHEN 3 THEN 'Unknown - see Narrative' ELSE NULL END AS engagement_status,
  CASE l_partkey % 9 WHEN 0 THEN 'Animal' WHEN 1 THEN 'Non-Motorist: Cyclist' WHEN 2 THEN 'First Responder Vehicle'
       WHEN 3 THEN 'Other, see Narrative' WHEN 4 THEN NULL WHEN 5 THEN 'Non-Motorist: Pedestrian' WHEN 6 THEN 'Other Fixed Object'
       ELSE 'Passenger Car' END AS crash_with,
  CASE l_suppkey % 4 WHEN 0 THEN 'Stopped' WHEN 1 THEN 'Parked' WHEN 2 THEN 'Making Left Turn' ELSE NULL END AS sv_movement,
  CASE l_partkey % 3 WHEN 0 THEN 'Proceeding Straight' WHEN 1 THEN 'Changing Lanes' ELSE NULL END AS cp_movement,
  CASE l_partkey % 4 WHEN 0 THEN 'No Injuries Reported' WHEN 1 THEN 'Minor' ELSE NULL END AS injury,
  CASE (l_partkey + l_suppkey) % {N_NARRATIVES} {NARRATIVE_CASES} END AS narrative
FROM n
"""


#: Besides the classified texts, some that the fixture's curated events have.
OVERRIDES = (
    *geo.OVERRIDES,
    ("CA, US", "US", "SAN FRANCISCO|CA|US", "stated as a state, known to be the city"),
    ("Phoenix, AZ, US", "US", "AZ|US", "known to be elsewhere in the state"),
    ("Kingwood, TX, US", "US", None, "known to be wrong"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw report rows of two generations, made from lineitem, orders and supplier."""
    names = ("lineitem", "orders", "supplier")
    sql = RAW_REPORTS
    for n in names:
        sql = sql.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reports as a written table: what was shuffled to find them is gone before they are shuffled by incident."""
    return io.stored(pipelines.latest_reports(raw_reports(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.build_incidents(raw_reports(spark, sf_dir))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.drafts_of(raw_reports(spark, sf_dir))


def titled_events(classified: DataFrame) -> DataFrame:
    """Drafts as titled events of a catalogue: three in four public, one in four curated."""
    e = ev.titled(ev.to_event(classified))
    digit = F.conv(F.substring("slug", 7, 1), 16, 10).cast("int")
    return e.withColumns(
        {
            "is_public": digit % 4 != 0,
            "origin": F.when(digit >= 12, "curated").otherwise("source-derived"),
            "first_published_at": F.lit(None).cast("timestamp"),
        }
    )


#: Columns of events that come from cues and hedges in the narratives of all reports.
CUED = {"automation_status", "causation_status", "causation_note", "scenario_tags"}
#: Columns of events that a map reads.
MAPPED = ("slug", "event_type", "valence", "developer_or_operator", "location_text", "location_country_code", "location_precision", "is_public", "origin")


def events(spark: SparkSession, sf_dir: str, *columns: str, keep: bool = False) -> DataFrame:
    """All drafts as :func:`titled_events`, with all columns or those named.

    Not kept, a query computes only what it reads. Kept, the rows are written
    once for queries that read them on several branches; named columns are
    all that is then computed and written. Cues and hedges travel with the
    reports, so they are read only where a column comes from them.
    """
    raw = raw_reports(spark, sf_dir)
    read = not columns or CUED & set(columns)
    e = titled_events(pipelines.drafts_of(raw) if read else pipelines.normalize(pipelines.build_incidents(raw)))
    e = e.select(*columns) if columns else e
    return io.stored(e) if keep else e


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source rows of all candidates; no classification is needed for them."""
    return ev.to_event_source(candidates(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, sources) of one written table of candidates, so raw rows are read, ranked and grouped once.

    Kept, the events are a written table too; else a query computes of them
    only what it reads, and should read none of the columns ``CUED``: cues and
    hedges are not read before the reports are grouped. The written reports
    are deleted once their candidates are.
    """
    r = reports(spark, sf_dir)
    c = io.stored(consolidate.build_candidates(evidence.marked_reports(r) if keep else r))
    io.discard(r)
    e = titled_events(pipelines.normalize(c))
    return (io.stored(e) if keep else e), ev.to_event_source(c)
