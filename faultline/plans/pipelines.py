"""Whole pipelines, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue, classify, consolidate, dedupe, dictionary, digest, events, evidence, geo, merge, quality, versions
from ..sources import io


def latest_reports(raw: DataFrame, *fields: str) -> DataFrame:
    """Raw rows of all generations to reports, the latest version of each, with all fields or those named."""
    kept = versions.split_placeholders(raw)[0]
    good = versions.raw_columns(versions.split_malformed_versions(kept)[0], fields)
    return versions.map_report(versions.latest_version(good), fields=fields)


def build_incidents(raw: DataFrame) -> DataFrame:
    """Raw rows to candidates: two shuffles, one for versions and one for incidents."""
    return consolidate.build_candidates(latest_reports(raw))


def marked_candidates(raw: DataFrame) -> DataFrame:
    """Raw rows to candidates; narratives are read before the reports are grouped."""
    return consolidate.build_candidates(evidence.marked_reports(latest_reports(raw)))


def drafts_of(raw: DataFrame) -> DataFrame:
    """Raw rows to classified drafts."""
    return normalize(marked_candidates(raw))


def normalize(candidates: DataFrame) -> DataFrame:
    """Candidates to classified drafts: narrow work only."""
    return classify.classify(evidence.extract_evidence(candidates))


def records(drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, sources, violations) of drafts; drafts with violations give no event. Each is one narrow pass."""
    checked = quality.with_draft_violations(drafts)
    good = quality.sound(checked)
    return events.to_event(good), events.to_event_source(good), quality.exploded(checked, "candidate_id")


def catalogue_page(corpus: DataFrame, names: DataFrame, number=1, size: int = catalogue.PAGE_SIZE, **facets) -> dict:
    """Rows of a page, counts, statistics of the whole corpus and facet options."""
    rows, counts = catalogue.page(dictionary.filter_events(corpus, names, **facets), number, size)
    return {
        "rows": catalogue.event_summary(rows),
        "stats": catalogue.valence_stats(corpus),
        "options": dictionary.facet_options(corpus, names),
        **counts,
    }


def map_query(corpus: DataFrame, override: DataFrame, places: DataFrame, names: DataFrame, bounds: tuple, event_type: str | None = None, valence: str | None = None, name: str | None = None, cap: int = catalogue.MAP_CAP) -> DataFrame:
    """Placed events in a box, with facets, at most ``cap`` with the count of all."""
    for column, wanted in (("event_type", event_type), ("valence", valence)):
        if wanted is not None:
            corpus = corpus.filter(F.col(column) == wanted)
    points = geo.event_map_in(corpus, override, places, *bounds)
    if name is not None:
        points = dictionary.filter_raw_in(points, names, name)
    return catalogue.capped(points, cap)


def publication_batch(linked: DataFrame, corpus: DataFrame, at: str) -> dict:
    """Eligible export rows get titles and are published; others are reported. All other columns are proven unchanged."""
    found = quality.publication_preconditions(linked)
    eligible = linked.join(found.select(F.col("key").alias("candidate_id")), "candidate_id", "left_anti")
    titles = events.titled(eligible).select("slug", "title")
    after = merge.publish(corpus, titles, at)
    fixed = [c for c in corpus.columns if c not in ("title", "is_public", "first_published_at", "slug")]
    unlike = merge.unlike_rows(corpus, after, "slug", fixed)
    with io.shuffles_removed(corpus.sparkSession):
        same = unlike.isEmpty() or merge.snapshot_diff(corpus.join(unlike, "slug", "left_semi"), after, "slug", fixed).isEmpty()
    if not same:
        raise ValueError("publishing changed other columns")
    return {
        "events": after,
        "exceptions": exception_report(found),
        "duplicate_titles": quality.duplicate_keys(titles, "title", "slug"),
        "digest": digest.corpus_digest(after, [c for c in after.columns if c != "action"]),
    }


def exception_report(found: DataFrame) -> DataFrame:
    """(key, failures): what each row fails, in order of rows. A row has at most as many failures as there are rules."""
    return found.groupBy("key").agg(F.array_sort(F.collect_list("rule")).alias("failures")).orderBy("key")


def curated_import(records: DataFrame, existing: DataFrame, overrides: DataFrame, target: DataFrame) -> dict:
    """Imports of a manifest: checked, given slugs, and upserted."""
    found = quality.manifest_violations(records, existing)
    imports = catalogue.select_imports(records)
    slugs = dedupe.title_slugs(imports, "proposed_title", existing, overrides)
    rows = slugs.select(*(c for c in target.columns if c in slugs.columns))
    return {"violations": found, "slugs": slugs, "events": merge.upsert_by_key(target, rows, ["slug"])}


def decision_report(records: DataFrame) -> DataFrame:
    """Counts by collection and decision with all margins; null stands for all."""
    return records.cube("collection", "decision").agg(F.count(F.lit(1)).alias("n"))
