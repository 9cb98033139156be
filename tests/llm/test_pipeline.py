"""The pipeline against a plain version of its stages, and the registered queries against their contracts."""

import random
import zlib

import pytest

import corpus_pipeline
from faultline.llm import mixing, pii, quality_rules
from tests.llm.test_tables import links_of, near_copies
from tests.llm.test_texts import library, plain_stats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    docs = [(i, t + (f" mail x{i}@a.example now" if i % 5 == 0 else "")) for i, t in near_copies(21, [20, 60, 120, 300], 70)]
    docs += [(5000, None), (5001, ""), (5002, "again and again " * 30)]
    rows = [(d, t, rnd.choice(["en", "fr", None]), rnd.choice(["hot", "hot", "s1", "s2", None]), len(t or "")) for d, t in docs]
    rows.append(rows[3])
    path = f"file://{tmp_path_factory.mktemp('docs')}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_pipeline_against_plain_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    written = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        written[name] = docs = docs.cache()
    good = [r for r in rows if plain_stats(r[1] or "")[0] >= 50 and 2 * plain_stats(r[1])[4] <= plain_stats(r[1])[0]]
    assert sorted(map(tuple, written["quality"].collect()), key=str) == sorted(good, key=str)
    classes = links_of({r[0]: r[1] for r in good}.items(), 80, 5)
    first = {r[0]: r for r in good if classes[r[0]][1] == r[0]}
    assert sorted(map(tuple, written["near_duplicates"].collect()), key=str) == sorted(first.values(), key=str)
    detector = pii.fitted(written["near_duplicates"])
    clean = {}
    for d, t, lang, source, _ in first.values():
        text = pii.redacted(t, detector.spans(t)[1])
        clean[d] = (d, text, lang, source, len(text))
    assert {r.doc_id: tuple(r) for r in written["personal_data"].collect()} == clean
    assert all("@" not in t for _, t, *_ in clean.values())
    sampled = {r.doc_id for r in mixing.mixing_report(written["personal_data"]).collect() if r.sampled}
    kept = {r.doc_id: tuple(r) for r in written["mixing"].collect()}
    assert kept == {d: clean[d] for d in sampled} and 0 < len(kept) < len(clean)
    pieces = written["packing"].collect()
    ids = {d: [*library().encode(t, add_special_tokens=False).ids, 0] for d, t, *_ in kept.values()}
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        part = b"".join(x.to_bytes(4, "little") for x in ids[p.doc_id][p.start : p.start + p.length])
        assert len(part) == 4 * p.length and p.ids_crc32 == zlib.crc32(part)
    key = lambda df: sorted(map(tuple, df))
    assert key(corpus_pipeline.run(spark, path).collect()) == key(pieces)


def test_stage_names_and_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), path).columns == docs.columns


def test_hosts_are_sound_in_the_fixture(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert quality_rules.quality_rules(docs).filter("host_rejected").count() == 0
