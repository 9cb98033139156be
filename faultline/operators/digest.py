"""Order-free fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_digest(df: DataFrame, cols: list[str], levels: int = 3) -> DataFrame:
    """One row (rows, digest) that depends on the projected rows alone, not on their order or partitioning.

    A row's hash is SHA-256 over its JSON with nulls kept. Hashes are gathered
    by a hexadecimal prefix and hashed in order, one level after the other, so
    that no group holds more than its prefix' share. Equal rows are counted
    first, so a third of all rows being alike is one entry.
    """
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    out = hashed.select(F.concat_ws(":", "h", "n").alias("h"), "n")
    for level in range(levels, -1, -1):
        prefix = F.substring("h", 1, 2 * level)
        keyed = out.groupBy(prefix.alias("p")).agg(F.array_sort(F.collect_list("h")).alias("hs"), F.sum("n").alias("n"))
        out = keyed.select(F.concat("p", F.sha2(F.array_join("hs", ","), 256)).alias("h"), "n")
    return out.select(F.col("n").alias("rows"), F.col("h").alias("digest"))
