"""Two incidents whose MD5s begin with the same eight digits: each keeps its own event, sources, link and title."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__

from faultline.functions import text

TWINS = ("same-incident:I113414", "same-incident:I147270")
QUERIES = (
    "w6_publication_batch", "a17_before_after", "a20_qa_counters", "o6_exception_report", "m6_set_origin", "m7_publish", "m15_merge_events", "m4_promote",
    "m4_promotion_states", "m5_promotion_problems", "s6_export_linked", "s7_read_corpus", "v8_corpus_invariants", "v2_structural_qa", "v3_publication",
)


@pytest.fixture(scope="module")
def twins(spark, tmp_path_factory):
    """The rows of both incidents, and of no others."""
    out, src = tmp_path_factory.mktemp("twins"), "/root/testdata/sf0.1"
    keys = [113414, 113415, 147270, 147271]
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("supplier", None)):
        t = spark.read.parquet(f"{src}/{name}.parquet")
        (t.filter(F.col(key).isin(keys)) if key else t).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_slugs_of_twins_differ(spark):
    rows = spark.createDataFrame([(t,) for t in TWINS], "id string")
    short, whole = zip(*((r[0], r[1]) for r in rows.select(text.hash_slug("nhtsa-", F.col("id")), text.event_slug(F.col("id"))).collect()))
    assert len(set(short)) == 1 and len(set(whole)) == 2
    assert all(w.startswith(s) for s, w in zip(short, whole))


@pytest.mark.parametrize("name", QUERIES)
def test_twins_stay_apart(spark, twins, name):
    df = __spark_entry__.queries()[name](spark, twins)
    db = duckdb.connect()
    for t in ("lineitem", "orders", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{twins}/{t}.parquet/*.parquet'")
    db.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in db.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in db.fetchall())
