"""A corpus pipeline of five stages over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import jaccard_join, mixing, packing, pii, quality_rules
from faultline.llm.common import stored
from faultline.llm.queries import PACKING_RANKS, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host passes; null and wordless texts go, a null source has no host."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more.

    The smallest doc_id of a group stays, and one row of those that repeat it;
    rows without a doc_id, a text or words stay.
    """
    return jaccard_join.keep_one(docs, percent=80, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data redacted; null and empty texts stay as they are."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose source, language and topic weights follow the targets.

    Nulls in a dimension are a value of their own; rows that repeat a doc_id
    in one cell share their fate; a cell without words gives no rows.
    """
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is the closing id alone, and repeated rows are packed as they come."""
    return packing.pack(docs, tokenizer(PACKING_RANKS))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", packed),
]

#: Tokenization and boosted trees are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to what the one before it has written; an empty table gives no rows."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stored(out)
    return out
