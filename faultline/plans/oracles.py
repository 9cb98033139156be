"""SQL for DuckDB with the results of the registered queries."""

from __future__ import annotations

from ..functions.text import MARKED, PLAIN
from ..operators import dictionary, evidence, geo, quality
from ..operators import rules_data as R
from ..operators.consolidate import EVENT_WORDS, FILING_PHRASES, MIRRORED
from ..operators.events import EVENT_TYPE_LABELS
from .fixtures import OVERRIDES, RAW_REPORTS


def text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def rows(table: list[tuple]) -> str:
    cell = lambda v: text(v) if v is None or isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in table)


def re2(p: str) -> str:
    """A pattern without look-behind; its match starts up to three characters earlier."""
    return p.replace("(?<!dis)", "(?:^|[^s]|[^i]s|[^d]is)")


def any_of(c: str, patterns: tuple[str, ...]) -> str:
    return f"coalesce(regexp_matches({c}, {text('(?i)' + '|'.join(f'(?:{re2(p)})' for p in patterns))}), false)"


def quoted(c: str, patterns: tuple[str, ...]) -> str:
    """The first pattern's match, in the order of the list."""
    parts = []
    for p in patterns:
        q = re2(p)
        group = 1 if q != p else 0
        q = "(?:^|[^s]|[^i]s|[^d]is)(" + p.replace("(?<!dis)", "") + ")" if group else q
        parts.append(f"nullif(regexp_extract({c}, {text('(?i)' + q)}, {group}), '')")
    return f"coalesce({', '.join(parts)})"


def last(c: str, patterns: tuple[str, ...]) -> str:
    return f"length(regexp_extract({c}, {text(r'(?i)^([\s\S]*)(?:' + '|'.join(f'(?:{re2(p)})' for p in patterns) + ')')}, 1))"


def chain(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {text(v) if not v.startswith('=') else v[1:]}" for c, v in rules) + f" ELSE {text(default)} END"


ADMIN = "'No New or Updated Incident Reports'"
GOOD = "regexp_full_match(trim(report_version), '0*[0-9]{1,18}')"
LATEST = f"""
raw AS ({RAW_REPORTS}),
good AS (SELECT *, CAST(trim(report_version) AS BIGINT) AS version FROM raw
  WHERE report_type IS DISTINCT FROM {ADMIN} AND {GOOD}),
latest AS (SELECT * FROM (
  SELECT *, min(src_ord) OVER (PARTITION BY generation, report_id) AS first_ord,
    row_number() OVER (PARTITION BY generation, report_id ORDER BY version DESC, src_ord) AS rn FROM good) WHERE rn = 1)
"""
REPORTS = f"""{LATEST},
reports AS (SELECT generation AS reporting_generation, report_id, version AS report_version,
  nullif(trim(same_incident_id), '') AS same_incident_id, reporting_entity,
  coalesce(operating_entity, reporting_entity) AS developer_or_operator,
  CASE WHEN regexp_full_match(trim(incident_date), '[A-Za-z]{{3}}-[0-9]{{4}}')
    THEN CAST(try_strptime('01-' || trim(incident_date), '%d-%b-%Y') AS DATE) END AS incident_date,
  trim(incident_date) AS raw_date, city, state, 'US' AS country_code,
  CASE WHEN generation = 'current' THEN engagement_status END AS automation_engagement_text,
  crash_with AS crash_interaction_counterpart_text, sv_movement AS subject_vehicle_precrash_movement_text,
  cp_movement AS other_actor_precrash_movement_text, injury AS injury_outcome_text, narrative, first_ord
  FROM latest)
"""
SCORE = " + ".join(f"CAST({any_of('narrative', (p,))} AS INT)" for p in EVENT_WORDS) + " - 2 * (" + " + ".join(f"CAST({any_of('narrative', (p,))} AS INT)" for p in FILING_PHRASES) + ")"
FIELDS = [*MIRRORED.values(), "incident_date"]
CANDIDATES = f"""{REPORTS},
keyed AS (SELECT *, coalesce('same-incident:' || same_incident_id, 'singleton:' || reporting_generation || ':' || report_id) AS candidate_id FROM reports),
ordered AS (SELECT *, row_number() OVER (PARTITION BY candidate_id
  ORDER BY CASE reporting_generation WHEN 'historical' THEN 0 ELSE 1 END, first_ord) AS ord, {SCORE} AS score FROM keyed),
said AS ({" UNION ALL ".join(f"SELECT candidate_id, {i} AS i, '{f}' AS field, {f if f != 'incident_date' else "strftime(incident_date, '%Y-%m-%d') || '|month'"} AS v, ord FROM ordered" for i, f in enumerate(FIELDS))}),
vals AS (SELECT candidate_id, i, field, v, min(ord) AS o FROM said WHERE v IS NOT NULL GROUP BY ALL),
disagree AS (SELECT candidate_id, i, field, string_agg(v, ' / ' ORDER BY o) AS said, count(*) AS n, list(v ORDER BY o) AS vs
  FROM vals GROUP BY ALL HAVING count(*) > 1),
notes AS (SELECT candidate_id, 'Import: contributing reports disagree on ' || string_agg(field || ' (' || said || ')', '; ' ORDER BY i)
  || '. Left blank for curator review.' AS curator_note FROM disagree GROUP BY candidate_id),
cand AS (SELECT candidate_id, min(same_incident_id) AS same_incident_id,
  {", ".join(f"CASE WHEN count(DISTINCT {f}) = 1 THEN min({f}) END AS {c}" for c, f in MIRRORED.items())},
  CASE WHEN count(DISTINCT incident_date) = 1 THEN min(incident_date) END AS incident_date,
  CASE WHEN count(DISTINCT incident_date) = 1 THEN 'month' ELSE 'unknown' END AS incident_date_precision,
  'US' AS country_code,
  first(narrative ORDER BY score DESC, length(narrative) DESC, reporting_generation, report_id) FILTER (narrative IS NOT NULL) AS narrative,
  count(*) AS n_reports, first(automation_engagement_text ORDER BY ord) FILTER (automation_engagement_text IS NOT NULL) AS first_engagement,
  count(DISTINCT reporting_entity) AS entities
  FROM ordered GROUP BY candidate_id)
"""
T = "narrative"
ON, OFF = any_of(T, R.ENGAGED), any_of(T, R.NOT_ENGAGED)
CUES = f"""{CANDIDATES},
cues AS (SELECT candidate_id, report_id, reporting_generation, ord, narrative,
  CASE WHEN {ON} AND (NOT {OFF} OR {last(T, R.ENGAGED)} > {last(T, R.NOT_ENGAGED)}) THEN 'engaged'
    WHEN {OFF} AND (NOT {ON} OR {last(T, R.NOT_ENGAGED)} > {last(T, R.ENGAGED)}) THEN 'not-engaged' END AS value FROM ordered),
hedges AS ({" UNION ALL ".join(f"SELECT candidate_id, report_id, '{t}' AS topic, {quoted(T, p)} AS phrase FROM ordered" for t, p in R.HEDGES.items())})
"""


def sentence(phrase: str) -> str:
    return f"list_filter(regexp_split_to_array({T}, '[.!?]\\s+'), lambda s: contains(s, {phrase}))[1]"


CONTROL, OCCUPIED = quoted(T, R.HUMAN_CONTROL), quoted(T, R.OCCUPANT)
LATE = f"""coalesce(length(regexp_extract({sentence(CONTROL)}, {text('(?i)^(.*?)(?:' + R.AFTER_CONTACT + ')')}, 1)) < strpos({sentence(CONTROL)}, {CONTROL}) - 1
  AND {any_of(sentence(CONTROL), (R.AFTER_CONTACT,))}, false)"""
CP = "crash_interaction_counterpart"
FLAG_SQL = {
    "multi_contact": f"coalesce(len(regexp_extract_all({T}, {text('(?i)' + '|'.join(f'(?:{p})' for p in R.CONTACT_VERBS))})), 0) >= {R.MULTI_CONTACT}",
    "no_contact": any_of(T, R.NO_CONTACT),
    "rear_ended": any_of(T, R.REAR_END),
    "emergency_response": any_of(T, R.EMERGENCY),
    "handled_well": f"{any_of(T, R.BRAKED_TO_STOP)} AND {any_of(T, R.STOPPED_CONTACT)}",
    "not_struck": f"{any_of(T, R.NOT_DAMAGED)} AND {any_of(T, R.DAMAGE)} AND {any_of(T, R.TWO_OTHERS)}",
    "infrastructure": f"{any_of(T, R.INFRASTRUCTURE)} AND ({CP} IS NULL OR {CP} IN ({', '.join(map(text, R.NO_OTHER_PARTY))})) AND NOT {any_of(T, R.OTHER_ACTOR)}",
    "traffic_violation": any_of(T, R.TRAFFIC_VIOLATION),
    "lane_intrusion": any_of(T, R.LANE_INTRUSION),
    "automation_first": any_of(T, R.AUTOMATION_FIRST),
    "human_first": f"{CONTROL} IS NOT NULL AND NOT {LATE}",
    "human_untimed": f"{CONTROL} IS NOT NULL AND {LATE}",
    "occupant_action": f"{OCCUPIED} IS NOT NULL AND NOT {any_of(f'coalesce({sentence(OCCUPIED)}, {T})', (R.OTHER_OWNER,))}",
}
FLAGGED = f"""{CUES},
flags AS (SELECT *, {", ".join(f"{s} AS {k}" for k, s in FLAG_SQL.items())} FROM cand)
"""
CONFLICTS = f"""
conflict AS (SELECT d.candidate_id, CASE field {" ".join(f"WHEN '{f}' THEN '{c}'" for c, f in MIRRORED.items())} END AS field, vs, n, i
  FROM disagree d WHERE field IN ({", ".join(f"'{MIRRORED[c]}'" for c in R.CHECKED_FIELDS)})),
folded AS (SELECT *, len(list_distinct(list_transform(vs, lambda v: trim(regexp_replace(regexp_replace(lower(v), '[-.,]', ' ', 'g'), '\\s+', ' ', 'g'))))) AS names,
  list_transform(vs, lambda v: trim(regexp_replace(regexp_replace(lower(v), '[.,]', '', 'g'), '\\s+', ' ', 'g'))) AS texts,
  (list_sort(list_transform(vs, lambda v: {{'n': length(v), 'v': v}}))[1]).v AS shortest FROM conflict),
resolved AS (SELECT candidate_id,
  max(CASE WHEN field = 'developer_or_operator' AND names = 1 THEN shortest END) AS developer_canonical,
  max(CASE WHEN field = 'city' AND n = 2 AND len(list_distinct(texts)) = 1 THEN shortest
    WHEN field = 'city' AND n = 2 AND list_contains(list_transform(vs, lambda v: trim(lower(v))), 'san fancisco') AND list_contains(texts, 'san francisco') THEN 'San Francisco' END) AS city_canonical,
  string_agg(field, ',' ORDER BY i) AS conflicts,
  count(*) FILTER (field IN ({", ".join(map(text, R.SHAPE_FIELDS))})) AS shape, count(*) AS n_conflicts
  FROM folded GROUP BY candidate_id)
"""
ENG = "CASE {} " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in (("Verified Engaged", "driving-automation-engaged-confirmed"), ("Verified Not Engaged", "driving-automation-not-engaged"), ("Alleged Engaged", "driving-automation-engaged-reported"), ("Unknown - see Narrative", "driving-automation-status-uncertain"))) + " END"
MAPPED = ENG.format("coalesce(automation_engagement, first_engagement)")
SM, OM = "subject_vehicle_precrash_movement", "other_actor_precrash_movement"
UND, THEIRS = "undetermined", "other-party-contributed"
SUPPORTED = "((automation_status IN ('driving-automation-engaged-confirmed', 'driving-automation-engaged-reported') AND NOT human_first) OR automation_first)"
CAUSES = [
    ("not_struck", UND, 1), ("multi_contact", UND, 0), (f"infrastructure AND {SUPPORTED}", "automation-system-contributed", 1),
    ("infrastructure", UND, 0), (f"{CP} = 'Animal'", UND, 1), ("rear_ended", THEIRS, 1), ("traffic_violation", THEIRS, 1),
    ("lane_intrusion", THEIRS, 1), ("occupant_action", UND, 0), (f"{SM} IN ('Stopped', 'Parked') AND {OM} IS NOT NULL", THEIRS, 1),
]
TYPES = [
    ("not_struck", "traffic-disruption-or-obstruction"), ("infrastructure", "unexpected-or-inappropriate-behaviour"),
    (f"{CP} = 'Animal'", "other"), (f"{CP} ILIKE 'Non-Motorist%'", "vulnerable-road-user-interaction"),
    (f"{CP} = 'First Responder Vehicle' AND emergency_response", "emergency-vehicle-interaction"), ("no_contact", "other"),
]
NEUTRAL = "neutral-or-unclear"
VALENCE = [("not_struck", NEUTRAL), ("infrastructure", "failure-or-challenging"), (f"{CP} = 'Animal'", NEUTRAL), ("handled_well", "successful-handling")]
TAGS = [
    ("not_struck", "debris-avoidance-braking,third-party-chain-collision,av-not-physically-involved"),
    ("infrastructure", "single-vehicle-infrastructure-contact,parking-lot-maneuver,no-other-party"),
    (f"{CP} = 'Animal'", "animal-strike"),
    (f"{CP} = 'Animal' AND (handled_well OR {any_of(T, R.AVOIDANCE)})", "attempted-avoidance-maneuver"),
    (f"event_type = 'vulnerable-road-user-interaction' AND {CP} ILIKE '%Cyclist%'", "cyclist-interaction"),
    (f"event_type = 'vulnerable-road-user-interaction' AND {CP} ILIKE '%Pedestrian%'", "pedestrian-interaction"),
    (f"{CP} = 'First Responder Vehicle' AND event_type = 'collision'", "police-vehicle"),
    ("rear_ended", "struck-from-behind"),
    ("coalesce(off, false) OR automation_engagement = 'Verified Not Engaged'", "autonomy-disengaged-before-impact"),
]
DRAFTS = f"""{FLAGGED}, {CONFLICTS},
cue AS (SELECT candidate_id, count(DISTINCT value) AS kinds, min(value) AS one, bool_or(value = 'not-engaged') AS off FROM cues WHERE value IS NOT NULL GROUP BY candidate_id),
base AS (SELECT f.*, r.* EXCLUDE (candidate_id), kinds, one, off, coalesce(shape, 0) >= 2 AS inconsistent,
  CASE WHEN coalesce(city_canonical, city) IS NOT NULL THEN 'city' WHEN state IS NOT NULL THEN 'region' ELSE 'country' END AS location_precision
  FROM flags f LEFT JOIN resolved r ON f.candidate_id = r.candidate_id LEFT JOIN cue ON f.candidate_id = cue.candidate_id),
d1 AS (SELECT *, coalesce({MAPPED}, CASE WHEN kinds = 1 AND one = 'engaged' THEN 'driving-automation-engaged-confirmed'
    WHEN kinds = 1 THEN 'driving-automation-not-engaged' WHEN kinds > 1 THEN 'driving-automation-status-uncertain' ELSE 'unknown' END) AS automation_status,
  CASE WHEN {MAPPED} IS NULL AND kinds > 1 THEN 'contested' ELSE 'well-supported' END AS automation_status_confidence FROM base),
d2 AS (SELECT *, {chain([(c, v) for c, v, _ in CAUSES], UND)} AS raw_cause,
  {chain([(c, "well-supported" if w else "contested") for c, _, w in CAUSES], "contested")} AS raw_conf,
  {chain(TYPES, "collision")} AS event_type, 'well-supported' AS event_type_confidence, {chain(VALENCE, NEUTRAL)} AS valence,
  {chain([(c, "well-supported") for c, _ in VALENCE], "contested")} AS valence_confidence FROM d1),
drafts AS (SELECT *, CASE WHEN raw_cause = '{THEIRS}' AND occupant_action THEN '{UND}' ELSE raw_cause END AS causation_status,
  CASE WHEN raw_cause = '{THEIRS}' AND occupant_action THEN 'contested' WHEN coalesce(shape, 0) > 0 THEN 'contested' ELSE raw_conf END AS causation_status_confidence,
  coalesce(concat_ws(',', {", ".join(f"CASE WHEN {c} THEN {text(v)} END" for c, v in TAGS)}), '') AS tags,
  coalesce(n_conflicts, 0) - CASE WHEN developer_canonical IS NULL THEN 0 ELSE 1 END - CASE WHEN city_canonical IS NULL THEN 0 ELSE 1 END + CAST(inconsistent AS INT) AS n_unknowns,
  'nhtsa-' || md5(candidate_id) AS slug,
  concat_ws(', ', coalesce(city_canonical, city), state, 'US') AS location_text,
  coalesce(developer_canonical, developer_or_operator) AS operator FROM d2)
"""
DIGIT = "CAST('0x' || substr(slug, 7, 1) AS INT)"
TITLE = (
    "CASE WHEN operator IS NOT NULL THEN concat_ws(' — ', operator || ' ' || CASE event_type "
    + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in EVENT_TYPE_LABELS.items())
    + " END, location_text, CASE WHEN incident_date_precision = 'month' THEN strftime(incident_date, '%B %Y') END) END"
)
CORPUS = f"""{DRAFTS},
events AS (SELECT candidate_id, slug, {TITLE} AS title, incident_date AS occurred_on, incident_date_precision AS occurred_on_precision, location_text,
  'US' AS location_country_code, location_precision, operator AS developer_or_operator, automation_status, event_type, valence, causation_status,
  {DIGIT} % 4 <> 0 AS is_public, CASE WHEN {DIGIT} >= 12 THEN 'curated' ELSE 'source-derived' END AS origin FROM drafts),
sources AS (SELECT 'nhtsa-' || md5(candidate_id) AS event_slug, reporting_generation || ':' || report_id AS external_record_id,
  reporting_entity AS publisher, 'NHTSA SGO report ' || report_id || ' (v' || report_version || ')' AS label, 'unknown' AS published_on_precision FROM ordered)
"""
N = "CAST('0x' || substr({}, 8, 2) AS INT) % 16"
BROKEN = f"""{CORPUS},
be AS (SELECT * REPLACE (CASE WHEN {N.format("slug")} = 1 THEN 'bad' ELSE valence END AS valence,
    CASE WHEN {N.format("slug")} = 2 THEN NULL ELSE developer_or_operator END AS developer_or_operator,
    CASE WHEN {N.format("slug")} = 3 THEN NULL ELSE occurred_on END AS occurred_on),
  CASE WHEN {N.format("slug")} = 0 THEN ' ' END AS summary, {N.format("slug")} = 4 AS no_update FROM events),
bs AS (SELECT event_slug, CASE WHEN {N.format("event_slug")} = 6 THEN 'x' ELSE external_record_id END AS external_record_id FROM sources WHERE {N.format("event_slug")} <> 5),
twice AS (SELECT event_slug FROM bs GROUP BY event_slug, external_record_id HAVING count(*) > 1),
bare AS (SELECT slug FROM be WHERE slug NOT IN (SELECT event_slug FROM bs)),
qa AS (SELECT 'public' AS rule FROM be WHERE is_public UNION ALL SELECT 'enum:valence' FROM be WHERE valence = 'bad'
  UNION ALL SELECT 'occurred-on' FROM be WHERE (occurred_on IS NULL) <> (occurred_on_precision = 'unknown')
  UNION ALL SELECT 'curator-field' FROM be WHERE title IS NOT NULL OR summary IS NOT NULL
  UNION ALL SELECT 'external-id' FROM bs WHERE external_record_id = 'x'
  UNION ALL SELECT 'duplicate-external-id' FROM twice UNION ALL SELECT 'no-source' FROM bare)
"""
PLACES = f"places(key, level, country_code, region_code, city_name, latitude, longitude, display_name) AS (VALUES {rows(geo.PLACES)})"
OVER = f"over(location_text, location_country_code, lookup_key, rationale) AS (VALUES {rows(OVERRIDES)})"
MAP = f"""{CORPUS}, {PLACES}, {OVER},
tokens AS (SELECT slug, event_type, valence, developer_or_operator, location_country_code AS cc,
  CASE WHEN location_text LIKE '%,%,%' THEN upper(trim(split_part(location_text, ',', 1))) END AS ct,
  CASE WHEN location_text LIKE '%,%,%' THEN upper(trim(split_part(location_text, ',', 2)))
    WHEN location_text LIKE '%,%' THEN upper(trim(split_part(location_text, ',', 1))) END AS rt
  FROM events WHERE is_public AND origin = 'source-derived' AND location_text IS NOT NULL),
points AS (SELECT e.slug, e.event_type, e.valence, e.developer_or_operator, p.latitude, p.longitude, p.level AS resolved_level
  FROM events e JOIN over o ON e.location_text IS NOT DISTINCT FROM o.location_text AND e.location_country_code IS NOT DISTINCT FROM o.location_country_code
  JOIN places p ON p.key = o.lookup_key WHERE e.is_public AND e.origin = 'curated'
  UNION ALL SELECT slug, event_type, valence, developer_or_operator, coalesce(c.latitude, r.latitude, n.latitude),
    coalesce(c.longitude, r.longitude, n.longitude), coalesce(c.level, r.level, n.level)
  FROM tokens t LEFT JOIN places c ON c.level = 'city' AND c.key = ct || '|' || rt || '|' || cc
  LEFT JOIN places r ON r.level = 'region' AND r.key = rt || '|' || cc LEFT JOIN places n ON n.level = 'country' AND n.key = cc
  WHERE coalesce(c.latitude, r.latitude, n.latitude) IS NOT NULL)
"""
NAMES = f"names(raw, canonical) AS (VALUES {rows([(r, c) for c, rs in dictionary.NAMES.items() for r in rs])})"
NAMED = f"{CORPUS}, {NAMES}, named AS (SELECT e.*, coalesce(canonical, developer_or_operator) AS canonical FROM events e LEFT JOIN names ON raw = developer_or_operator)"
SNAP = f"""{REPORTS},
tgt AS (SELECT * FROM reports WHERE first_ord % 3 <> 0),
src AS (SELECT * REPLACE (report_version + CASE WHEN first_ord % 5 = 0 THEN 1 ELSE 0 END AS report_version,
  CASE WHEN first_ord % 7 = 0 THEN 'Elsewhere' ELSE city END AS city) FROM reports)
"""
def slug_base_sql(c: str) -> str:
    plain = f"translate(lower({c}), '{MARKED}', '{PLAIN}')"
    plain = f"regexp_replace(regexp_replace({plain}, '([a-z0-9])[''’`´]s\\b', '\\1', 'g'), '[''’`´]', '', 'g')"
    return f"regexp_replace({SLUGIFY.format(plain)}, '^(?:a|an|the)-', '')"


SLUGIFY = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
KEPT = f"A-Za-z0-9{MARKED}{MARKED.upper()}"
URL_KEY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '')"
CAND_COLS = ", ".join(["c.candidate_id", "same_incident_id", *MIRRORED, "incident_date_precision", "country_code", "narrative"])


def w(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


ORACLE: dict[str, str] = {
    "w1_build_incidents": w(CANDIDATES, f"SELECT {CAND_COLS}, curator_note, 'pending' AS status, strftime(incident_date, '%Y-%m-%d') AS incident_date, n_reports FROM cand c LEFT JOIN notes n ON c.candidate_id = n.candidate_id"),
    "f1_placeholders": f"SELECT generation, count(*) FILTER (report_type = {ADMIN}) AS excluded, generation = 'current' AND count(*) FILTER (report_type = {ADMIN}) > 0 AS anomaly FROM ({RAW_REPORTS}) GROUP BY generation",
    "f2_malformed_versions": f"SELECT generation, src_ord, report_id, report_version FROM ({RAW_REPORTS}) WHERE NOT {GOOD}",
    "a1_latest_version": w(LATEST, "SELECT generation, report_id, version, src_ord, first_ord FROM latest"),
    "p3_map_report": w(REPORTS, "SELECT * EXCLUDE (raw_date, first_ord, incident_date), strftime(incident_date, '%Y-%m-%d') AS incident_date, CASE WHEN incident_date IS NULL THEN 'unknown' ELSE 'month' END AS incident_date_precision, incident_date IS NULL AND raw_date <> '' AS malformed_incident_date FROM reports"),
    "p4_report_anomalies": w(REPORTS, "SELECT reporting_generation, report_id, 'malformed-incident-date' AS anomaly FROM reports WHERE incident_date IS NULL AND raw_date <> ''"),
    "p5_partial_dates": """WITH k AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['day', 'month', 'year', 'unknown'][o_orderkey % 4 + 1] AS kind FROM orders)
        SELECT o_orderkey, kind, true AS legal, CASE kind WHEN 'day' THEN strftime(d, '%Y-%m-%d') WHEN 'month' THEN strftime(d, '%Y-%m') WHEN 'year' THEN strftime(d, '%Y') END AS partial,
        CASE kind WHEN 'day' THEN strftime(d, '%Y-%m-%d') WHEN 'month' THEN strftime(d, '%Y-%m-01') WHEN 'year' THEN strftime(d, '%Y-01-01') END AS pinned,
        coalesce(pinned, '') AS sort_key,
        CASE kind WHEN 'day' THEN strftime(d, '%-d %B %Y') WHEN 'month' THEN strftime(d, '%B %Y') WHEN 'year' THEN strftime(d, '%Y') ELSE 'Date unknown' END AS shown FROM k""",
    "a8_generation_stats": w(LATEST, f"SELECT * FROM (SELECT generation, count(*) AS raw_rows, count(*) FILTER (report_type = {ADMIN}) AS excluded, count(*) FILTER (report_type <> {ADMIN} AND NOT {GOOD}) AS malformed FROM raw GROUP BY generation) JOIN (SELECT generation, count(*) AS latest, count(*) FILTER (trim(same_incident_id) = '') AS blank_incident_ids, count(DISTINCT nullif(trim(same_incident_id), '')) AS distinct_incident_ids FROM latest GROUP BY generation) USING (generation)"),
    "a4_disagreements": w(CANDIDATES, "SELECT candidate_id, field, said FROM disagree"),
    "a9_disagreement_histogram": w(CANDIDATES, "SELECT field, count(*) AS candidates FROM disagree GROUP BY field"),
    "a10_group_stats": w(CANDIDATES, "SELECT count(*) AS candidates, count(*) FILTER (n_reports > 1) AS multi_report, max(n_reports) AS largest, count(*) FILTER (entities > 1) AS cross_entity, count(*) FILTER (same_incident_id IS NULL) AS singletons FROM cand"),
    "j1_reports_of": w(CANDIDATES, "SELECT candidate_id, ord, report_id, report_version FROM ordered"),
    "e1_engagement_cues": w(CUES, f"SELECT candidate_id, report_id, value, CASE value WHEN 'engaged' THEN {quoted(T, R.ENGAGED)} ELSE {quoted(T, R.NOT_ENGAGED)} END AS text FROM cues WHERE value IS NOT NULL"),
    "e2_hedges": w(CUES, "SELECT candidate_id, report_id, topic, phrase FROM hedges WHERE phrase IS NOT NULL"),
    "e3_narrative_flags": w(FLAGGED, f"SELECT candidate_id, {', '.join(f[0] for f in evidence.FLAGS)} FROM flags"),
    "e16_field_evidence": w(DRAFTS, "SELECT candidate_id, coalesce(conflicts, '') AS conflicts, developer_canonical, city_canonical, inconsistent, location_precision FROM drafts"),
    "c_classify": w(DRAFTS, "SELECT candidate_id, automation_status, causation_status, event_type, valence, automation_status_confidence, causation_status_confidence, event_type_confidence, valence_confidence, tags, n_unknowns FROM drafts"),
    "w2_events": w(DRAFTS, "SELECT slug, candidate_id, location_text, location_precision, operator AS developer_or_operator, event_type, valence, automation_status, causation_status, incident_date_precision AS occurred_on_precision, strftime(incident_date, '%Y-%m-%d') AS occurred_on, false AS is_public FROM drafts"),
    "p15_event_sources": w(CORPUS, "SELECT * FROM sources"),
    "p16_titles": w(CORPUS, "SELECT slug, title FROM events"),
    "v1_draft_violations": w(DRAFTS, """, k AS (SELECT candidate_id AS key, CAST('0x' || substr(md5(candidate_id), 1, 4) AS INT) % 8 AS k, d.* EXCLUDE (candidate_id) FROM drafts d)
        SELECT key, '3' AS rule FROM k WHERE k = 0 UNION ALL SELECT key, '1-2:event_type' FROM k WHERE k = 1
        UNION ALL SELECT key, '8' FROM k WHERE k = 2 AND n_unknowns - CAST(inconsistent AS INT) > 0 UNION ALL SELECT key, '24' FROM k WHERE k = 2 AND inconsistent""").replace("\n, k AS", ", k AS"),
    "v2_structural_qa": w(BROKEN, "SELECT rule, count(*) AS n FROM qa GROUP BY rule"),
    "a20_qa_counters": w(BROKEN, "SELECT "
        + ", ".join(f"count(*) FILTER (string_split(rule, ':')[1] = '{r}') AS n_{r.replace('-', '_')}, count(*) FILTER (string_split(rule, ':')[1] = '{r}') = 0 AS ok_{r.replace('-', '_')}" for r in quality.QA_RULES)
        + ", (SELECT count(*) FROM be) AS processed, (SELECT count(*) FROM be) AS generated, true AS ok_one_event_each, true AS ok_no_invalid_draft, (SELECT count(*) FROM bs) AS null_urls FROM qa"),
    "v3_publication": w(BROKEN, """, f AS (SELECT 'origin' AS rule FROM be WHERE origin = 'curated' UNION ALL SELECT 'public' FROM be WHERE is_public
        UNION ALL SELECT 'set:title' FROM be WHERE title IS NOT NULL UNION ALL SELECT 'set:summary' FROM be WHERE summary IS NOT NULL
        UNION ALL SELECT 'null:developer_or_operator' FROM be WHERE developer_or_operator IS NULL UNION ALL SELECT 'no-source' FROM bare)
        SELECT rule, count(*) AS n FROM f GROUP BY rule""").replace("\n, f AS", ", f AS"),
    "v5_row_constraints": w(BROKEN, "SELECT slug AS key, 'blank:summary' AS rule FROM be WHERE summary IS NOT NULL UNION ALL SELECT slug, 'enum:valence' FROM be WHERE valence = 'bad' UNION ALL SELECT slug, 'date-pair' FROM be WHERE (occurred_on IS NULL) <> (occurred_on_precision = 'unknown')"),
    "v6_keys": "SELECT l_orderkey || '-' || l_linenumber AS key, count(*) AS members FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "v6_references": "SELECT CAST(doc_id AS VARCHAR) AS key, 'unlabelled' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "v7_completeness": w(BROKEN, """, m AS (SELECT slug, origin, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN developer_or_operator IS NULL THEN 'developer_or_operator' END,
        CASE WHEN origin = 'curated' AND summary IS NULL THEN 'summary' END, CASE WHEN origin = 'curated' THEN 'review_status,observed_facts' END,
        CASE WHEN slug IN (SELECT slug FROM bare) THEN 'sources' END) AS missing FROM be WHERE is_public)
        SELECT * FROM m WHERE missing <> ''""").replace("\n, m AS", ", m AS"),
    "v8_corpus_invariants": w(BROKEN, "SELECT slug AS key, 'no-source' AS rule FROM bare UNION ALL SELECT slug, 'no-update' FROM be WHERE no_update"),
    "v10_transitions": """WITH b AS (SELECT p_partkey AS id, 's-' || p_partkey AS slug, p_partkey % 2 = 0 AS pub FROM part WHERE p_partkey % 11 <> 0),
        a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 't-' ELSE 's-' END || p_partkey AS slug, p_partkey % 3 <> 0 AS pub, p_partkey % 2 = 0 AS stamped FROM part WHERE p_partkey % 13 <> 0),
        j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS n, b.id IS NOT NULL AS o, a.slug AS s, b.slug AS bs, a.pub AS p, b.pub AS bp, a.stamped AS st FROM b FULL JOIN a ON a.id = b.id)
        SELECT CAST(id AS VARCHAR) AS key, 'frozen-slug' AS rule FROM j WHERE n AND o AND bp AND s <> bs UNION ALL SELECT CAST(id AS VARCHAR), 'created-public' FROM j WHERE NOT o AND p
        UNION ALL SELECT CAST(id AS VARCHAR), 'renamed-on-publish' FROM j WHERE n AND o AND NOT bp AND p AND s <> bs UNION ALL SELECT CAST(id AS VARCHAR), 'unstamped' FROM j WHERE n AND p AND NOT st
        UNION ALL SELECT CAST(id AS VARCHAR), 'deleted-public' FROM j WHERE NOT n AND bp""",
    "v11_submissions": """SELECT CAST(page_id AS VARCHAR) AS key, 'url' AS rule FROM pages WHERE page_id % 5 = 0 OR url IS NULL UNION ALL SELECT CAST(page_id AS VARCHAR), 'email' FROM pages WHERE page_id % 7 = 0
        UNION ALL SELECT CAST(page_id AS VARCHAR), 'text-length' FROM pages WHERE length(html) > 5000 UNION ALL SELECT CAST(page_id AS VARCHAR), 'date' FROM pages WHERE page_id % 3 = 0""",
    "m1_merge_reports": w(SNAP, """SELECT s.reporting_generation, s.report_id, CASE WHEN t.report_id IS NULL OR s.report_version > t.report_version OR s.city IS DISTINCT FROM t.city THEN s.report_version ELSE t.report_version END AS report_version,
        CASE WHEN t.report_id IS NULL OR s.report_version > t.report_version OR s.city IS DISTINCT FROM t.city THEN s.city ELSE t.city END AS city,
        CASE WHEN t.report_id IS NULL THEN 'insert' WHEN s.report_version > t.report_version OR s.city IS DISTINCT FROM t.city THEN 'update' ELSE 'noop' END AS action
        FROM src s LEFT JOIN tgt t ON s.reporting_generation = t.reporting_generation AND s.report_id = t.report_id"""),
    "m2_merge_candidates": w(CANDIDATES, """, x AS (SELECT same_incident_id, state, CAST(substr(same_incident_id, 2) AS BIGINT) AS n FROM cand WHERE same_incident_id IS NOT NULL)
        SELECT same_incident_id, CASE WHEN n % 8 = 0 AND (n % 3 = 0 OR n % 4 <> 0) THEN 'NV' ELSE state END AS state, CASE WHEN n % 3 <> 0 AND n % 4 = 0 THEN 'approved' ELSE 'pending' END AS status,
        CASE WHEN n % 3 = 0 THEN 'insert' WHEN n % 4 = 0 THEN 'frozen' ELSE 'noop' END AS action FROM x""").replace("\n, x AS", ", x AS"),
    "m3_merge_singletons": w(CANDIDATES, """, x AS (SELECT city, CAST('0x' || substr(md5(candidate_id), 1, 1) AS INT) AS d FROM cand WHERE same_incident_id IS NULL)
        SELECT CASE WHEN d % 2 = 1 THEN 'insert' WHEN d % 8 = 0 THEN 'frozen' WHEN d % 4 = 0 AND city IS DISTINCT FROM 'Elsewhere' THEN 'update' ELSE 'noop' END AS action,
        CASE WHEN d % 2 = 0 AND d % 8 = 0 THEN 'approved' ELSE 'pending' END AS status, count(*) AS n FROM x GROUP BY ALL""").replace("\n, x AS", ", x AS"),
    "m7_publish": w(CORPUS, "SELECT slug, CASE WHEN substr(slug, 6 + 0, 1) < '8' THEN title END AS title, substr(slug, 6, 1) < '8' AS is_public, CASE WHEN substr(slug, 6, 1) < '8' THEN 'update' ELSE 'noop' END AS action, substr(slug, 6, 1) < '8' AS stamped FROM events"),
    "m9_upsert": """WITH x AS (SELECT *, p_partkey % 3 = 0 OR p_partkey % 5 <> 0 AS sourced, p_partkey % 7 = 0 AS renamed FROM part)
        SELECT p_partkey, CASE WHEN sourced AND renamed THEN 'renamed' ELSE p_name END AS p_name,
        CASE WHEN p_partkey % 3 = 0 THEN 'insert' WHEN sourced AND renamed AND p_name <> 'renamed' THEN 'update' ELSE 'noop' END AS action FROM x""",
    "m10_delete": w(CORPUS, "SELECT (SELECT count(*) FROM events WHERE substr(slug, 6, 1) <> '0') AS events, (SELECT count(*) FROM sources WHERE substr(event_slug, 6, 1) <> '0') AS sources, (SELECT count(*) FROM events WHERE substr(slug, 6, 1) <> '0') AS links"),
    "m11_backfill": w(CORPUS, f", {PLACES}, {OVER} SELECT slug, CASE WHEN origin = 'curated' AND p.level IS NOT NULL THEN p.level ELSE 'unknown' END AS location_precision, CASE WHEN origin = 'curated' AND p.level IS NOT NULL THEN 'update' ELSE 'noop' END AS action FROM events e LEFT JOIN (SELECT o.*, level FROM over o JOIN places ON key = lookup_key) p ON e.location_text IS NOT DISTINCT FROM p.location_text AND e.location_country_code IS NOT DISTINCT FROM p.location_country_code").replace("\n, places", ", places"),
    "m13_submissions": "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN page_id % 9 = 0 THEN 'known' WHEN page_id % 3 = 0 THEN 'submission-' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) END AS linked_event_id FROM pages",
    "m14_reviews": """WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY conv_id)
        SELECT c.conv_id AS id, CASE WHEN role = 'assistant' THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN role = 'assistant' THEN 'r' || turn END AS reviewer,
        CASE WHEN role = 'assistant' THEN 'update' ELSE 'noop' END AS action FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l ON c.conv_id = l.conv_id""",
    "j2_link_reports": w(REPORTS, "SELECT report_id, reporting_generation, 'same-incident:' || same_incident_id AS candidate_id, same_incident_id IS NOT NULL AS changed FROM reports"),
    "j3_classify_writes": w(SNAP, "SELECT CASE WHEN t.report_id IS NULL THEN 'insert' WHEN s.report_version <> t.report_version THEN 'update' ELSE 'noop' END AS action, count(*) AS n FROM src s LEFT JOIN tgt t ON s.reporting_generation = t.reporting_generation AND s.report_id = t.report_id GROUP BY 1"),
    "j6_children": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents",
    "j9_snapshot_diff": w(SNAP, ", x AS (SELECT t.reporting_generation || ':' || t.report_id AS k, concat_ws(',', CASE WHEN s.report_version <> t.report_version THEN 'report_version' END, CASE WHEN s.city IS DISTINCT FROM t.city THEN 'city' END) AS changed FROM src s JOIN tgt t ON s.reporting_generation = t.reporting_generation AND s.report_id = t.report_id) SELECT * FROM x WHERE changed <> ''").replace("\n, x AS", ", x AS"),
    "u3_set_difference": "WITH a AS (SELECT c_custkey AS custkey FROM customer), b AS (SELECT DISTINCT CASE WHEN o_custkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS custkey FROM orders) SELECT custkey, 'left' AS side FROM a WHERE custkey NOT IN (SELECT custkey FROM b) UNION ALL SELECT custkey, 'right' FROM b WHERE custkey NOT IN (SELECT custkey FROM a)",
    "w3_event_map": w(MAP, "SELECT * FROM points"),
    "a16_resolution_report": w(MAP, "SELECT origin, count(*) FILTER (resolved_level = 'city') AS city, count(*) FILTER (resolved_level = 'region') AS region, count(*) FILTER (resolved_level = 'country') AS country, count(*) FILTER (resolved_level IS NULL) AS unmapped, count(*) FILTER (location_precision = 'city' AND resolved_level IN ('region', 'country') OR location_precision = 'region' AND resolved_level = 'country') AS coarser_than_stated FROM events e LEFT JOIN points p ON e.slug = p.slug WHERE is_public GROUP BY origin"),
    "a17_before_after": w(CORPUS, f", {PLACES}, {OVER}, x AS (SELECT CASE WHEN origin = 'curated' AND p.level IS NOT NULL THEN p.level ELSE 'unknown' END AS a FROM events e LEFT JOIN (SELECT o.*, level FROM over o JOIN places ON key = lookup_key) p ON e.location_text IS NOT DISTINCT FROM p.location_text AND e.location_country_code IS NOT DISTINCT FROM p.location_country_code) SELECT v AS value, CASE WHEN v = 'unknown' THEN (SELECT count(*) FROM x) ELSE 0 END AS before, (SELECT count(*) FROM x WHERE a = v) AS after, CASE WHEN v = 'unknown' THEN (SELECT count(*) FROM x WHERE a <> 'unknown') ELSE 0 END AS changed FROM (SELECT DISTINCT a AS v FROM x UNION SELECT 'unknown')").replace("\n, places", ", places"),
    "w5_map_query": w(MAP, f", {NAMES}, h AS (SELECT * FROM points WHERE latitude BETWEEN 30 AND 40 AND longitude BETWEEN -125 AND -100 AND valence = 'neutral-or-unclear' AND developer_or_operator IN (SELECT raw FROM names WHERE canonical = 'Waymo')) SELECT *, (SELECT count(*) FROM h) AS matched FROM h ORDER BY slug LIMIT 1000").replace("\n, names", ", names"),
    "j10_canonical": w(NAMED, "SELECT slug, canonical FROM named"),
    "a12_facets": w(NAMED, "SELECT DISTINCT canonical FROM named WHERE developer_or_operator IS NOT NULL AND developer_or_operator <> 'Internal employee'"),
    "a13_canonical_counts": w(NAMED, "SELECT CASE WHEN developer_or_operator = 'Internal employee' THEN NULL ELSE canonical END AS canonical, count(*) AS events FROM named GROUP BY 1"),
    "a14_coverage": w(NAMED, "SELECT 'missing' AS problem, raw FROM (SELECT DISTINCT developer_or_operator AS raw FROM events WHERE developer_or_operator IS NOT NULL) WHERE raw NOT IN (SELECT raw FROM names) UNION ALL SELECT 'extra', raw FROM names WHERE raw NOT IN (SELECT developer_or_operator FROM events WHERE developer_or_operator IS NOT NULL)"),
    "f3_filter_events": w(NAMED, "SELECT slug FROM named WHERE event_type = 'collision' AND valence = 'neutral-or-unclear' AND canonical = 'Waymo'"),
    "f5_filter_raw": w(NAMED, "SELECT slug, developer_or_operator FROM named WHERE developer_or_operator IN (SELECT raw FROM names WHERE canonical = 'Waymo')"),
    "s7_read_corpus": w(CORPUS, "SELECT event_slug AS slug, count(*) AS n, string_agg(external_record_id, ',' ORDER BY external_record_id) AS ids FROM sources GROUP BY 1"),
    "a11_valence_stats": w(CORPUS, "SELECT count(*) AS total, count(*) FILTER (valence = 'failure-or-challenging') AS failure_or_challenging, count(*) FILTER (valence = 'successful-handling') AS successful_handling, count(*) FILTER (valence = 'neutral-or-unclear') AS neutral_or_unclear FROM events"),
    "a18_cube": "SELECT c_mktsegment AS collection, o_orderstatus AS decision, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)",
    "p12_hash_slugs": f"SELECT p_partkey, 'nhtsa-' || substr(md5(p_name), 1, 8) AS slug, {SLUGIFY.format('p_name')} AS plain FROM part",
    "p18_title_slugs": f"""WITH t AS (SELECT doc_id, regexp_extract(text, '^(?:[^{KEPT}]*[{KEPT}]){{0,200}}[^{KEPT}]?') AS t FROM documents),
        b AS (SELECT *, {slug_base_sql("t")} AS f,
          list_filter(list_transform(list_filter(range(1, greatest(length(t), 1)), lambda i: regexp_matches(t[i + 1], '^[;:,–—]$') OR t[i + 1] = '.' AND regexp_full_match(t[i + 2], '\\s?')),
            lambda i: {slug_base_sql("t[1:i]")}), lambda s: length(s) BETWEEN 24 AND 80) AS c FROM t),
        m AS (SELECT *, list_sort(list_transform(c, lambda s: {{'n': length(s), 's': s}}), 'DESC')[1].s AS best, regexp_extract(f, '^(.{{1,79}})-', 1) AS cut FROM b),
        s AS (SELECT doc_id, CASE WHEN length(f) <= 80 THEN f WHEN best IS NOT NULL THEN best WHEN cut = '' THEN f[1:80] ELSE regexp_replace(cut, '-+$', '') END AS slug,
          CASE WHEN length(f) <= 80 THEN 'full' WHEN best IS NOT NULL THEN 'clause-cut' ELSE 'word-truncated' END AS method FROM m),
        k AS (SELECT *, count(*) OVER (PARTITION BY slug) > 1 OR slug = 'none' AS held FROM s)
        SELECT doc_id AS legacy_id, CASE WHEN held THEN slug || '-' || doc_id ELSE slug END AS slug, CASE WHEN held THEN method || '+disambiguated' ELSE method END AS method FROM k""",
    "p19_part_slugs": f"WITH s AS (SELECT p_partkey, {SLUGIFY.format('p_name')} AS raw FROM part), k AS (SELECT *, count(*) OVER (PARTITION BY raw) AS n FROM s) SELECT p_partkey AS legacy_id, CASE WHEN n > 1 THEN raw || '-' || p_partkey ELSE raw END AS slug, CASE WHEN n > 1 THEN 'full+disambiguated' ELSE 'full' END AS method FROM k",
    "p20_urls": f"SELECT page_id, {URL_KEY} AS url_key FROM pages",
    "p22_url_lines": "SELECT page_id, 3::BIGINT AS lines, url || ' https://a.example/x' AS hrefs FROM pages",
    "j12_exact_duplicates": f"""WITH p AS (SELECT page_id, url, {URL_KEY} AS k FROM pages), e AS (SELECT * FROM p WHERE page_id % 6 = 0)
        SELECT p.page_id AS legacy_id, 'e-' || e.page_id AS slug, 'media ' || e.page_id AS match FROM p JOIN e ON p.page_id = e.page_id AND p.page_id % 4 = 0
        UNION ALL SELECT p.page_id, 'e-' || e.page_id, 'url ' || p.k FROM p JOIN e ON p.k = e.k WHERE NOT (p.page_id % 12 = 0)""",
    "j13_frozen_keys": f"""WITH s AS (SELECT p_partkey AS legacy_id, {SLUGIFY.format('p_name')} AS before FROM part)
        SELECT legacy_id, before, CASE WHEN legacy_id % 10 = 0 THEN NULL WHEN legacy_id % 7 = 0 THEN 'moved' ELSE before END AS now,
        CASE WHEN legacy_id % 10 = 0 THEN 'dropped' ELSE 'changed' END AS problem FROM s WHERE legacy_id % 10 = 0 OR legacy_id % 7 = 0""",
    "d1_duplicate_tiers": w(CORPUS, """, r AS (SELECT slug AS id, substr(slug, 8, 4) AS u, trim(regexp_replace(regexp_replace(lower(developer_or_operator), '[-.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS op,
          event_type AS kind, location_text AS place, lower(title) AS t, occurred_on - DATE '1970-01-01' AS day FROM events),
        one AS (SELECT min(id) OVER (PARTITION BY u) AS x, id AS y, 1 AS tier FROM r QUALIFY x <> y),
        dated AS (SELECT * FROM r WHERE day IS NOT NULL AND op IS NOT NULL),
        signed AS (SELECT *, min(id) OVER (PARTITION BY op, kind, place, day) AS rep FROM dated WHERE place IS NOT NULL),
        sday AS (SELECT DISTINCT op, kind, place, day, rep FROM signed),
        two AS (SELECT rep AS x, id AS y FROM signed WHERE rep <> id UNION ALL SELECT x, y FROM
          (SELECT lag(rep) OVER p AS x, rep AS y, day - lag(day) OVER p AS gap FROM sday WINDOW p AS (PARTITION BY op, kind, place ORDER BY day)) WHERE gap <= 3),
        told AS (SELECT *, min(id) OVER (PARTITION BY op, kind, t, day) AS rep FROM dated WHERE t IS NOT NULL),
        tday AS (SELECT DISTINCT op, kind, t, day, rep FROM told),
        titles AS (SELECT DISTINCT op, kind, t, list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: t[i:i + 2])) AS g FROM tday),
        pairs AS (SELECT a.op, a.kind, a.t, b.t AS u FROM titles a JOIN titles b ON a.op = b.op AND a.kind = b.kind AND a.t < b.t
          WHERE len(list_intersect(a.g, b.g)) >= 0.5 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
        sides AS (SELECT p.*, 0 AS side, day, rep FROM pairs p JOIN tday d ON p.op = d.op AND p.kind = d.kind AND p.t = d.t
          UNION ALL SELECT p.*, 1, day, rep FROM pairs p JOIN tday d ON p.op = d.op AND p.kind = d.kind AND p.u = d.t),
        lasts AS (SELECT side, day, rep, last_value(CASE WHEN side = 0 THEN {'x': rep, 'd': day} END IGNORE NULLS) OVER p AS l0, last_value(CASE WHEN side = 1 THEN {'x': rep, 'd': day} END IGNORE NULLS) OVER p AS l1
          FROM sides WINDOW p AS (PARTITION BY op, kind, t, u ORDER BY day, side ROWS UNBOUNDED PRECEDING)),
        three AS (SELECT rep AS x, id AS y FROM told WHERE rep <> id
          UNION ALL SELECT x, y FROM (SELECT lag(rep) OVER p AS x, rep AS y, day - lag(day) OVER p AS gap FROM tday WINDOW p AS (PARTITION BY op, kind, t ORDER BY day)) WHERE gap <= 14
          UNION ALL SELECT CASE WHEN side = 0 THEN l1.x ELSE l0.x END, rep FROM lasts WHERE day - CASE WHEN side = 0 THEN l1.d ELSE l0.d END <= 14),
        every AS (SELECT * FROM one UNION ALL SELECT *, 2 FROM two UNION ALL SELECT *, 3 FROM three)
        SELECT least(x, y) AS a, greatest(x, y) AS b, min(tier) AS tier FROM every GROUP BY 1, 2""").replace("\n, r AS", ", r AS"),
    "d2_scores": """WITH t AS (SELECT quality, lang, CASE WHEN n_chars > 2000 THEN 1 WHEN n_chars < 300 THEN 0 END AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
        SELECT 'quality' AS field, lang AS subset, count(*) AS scored, count(p) AS predicted, count(*) FILTER (p = quality) AS correct,
        round(count(*) FILTER (p = quality) / nullif(count(p), 0), 6) AS precision, round(count(*) FILTER (p = quality) / count(*), 6) AS recall, round(1 - count(p) / count(*), 6) AS abstention FROM t GROUP BY lang""",
}
ORACLE["a2_consolidate"] = ORACLE["w1_build_incidents"]
