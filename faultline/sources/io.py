"""Readers and writers: raw generations, nested records, side outputs, exports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalogue import nested_sources

CORRUPT = "_corrupt"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a new local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


#: Whether Spark removes the shuffle files of a query as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What actions in this block shuffle is removed when they end, so that it does not lie on disk beside the shuffles of the next step.

    Without that setting it stays until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back: later plans start at its columns, and no lost executor undoes it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`stored` has written; nothing that is still to be computed may read it."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if not re.search(r"/table-[0-9a-f]{32}$", folder):
            raise ValueError(f"{folder} was not written by stored")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], expected: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Write ``df`` to ``path`` if it has the expected counts; else write nothing there and return name: (actual, expected).

    ``counts`` are aggregates by name, observed while the rows are written, so
    there is no second scan; they stand right before the write, in the stage
    whose tasks count once however often they run. Rows go to a folder beside
    ``path`` that takes its name only when all counts hold.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.unchecked-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *(F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in counts.items())).write.parquet(aside)
    actual = seen.get
    off = {n: (actual.get(n), v) for n, v in expected.items() if actual.get(n) != v}
    off |= {n: (v, None) for n, v in actual.items() if n not in expected}
    name = spark._jvm.org.apache.hadoop.fs.Path
    files = name(aside).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if off:
        files.delete(name(aside), True)
    elif not files.rename(name(aside), name(path)):
        raise OSError(f"could not rename {aside} to {path}")
    return off


def read_generation(
    spark: SparkSession, path: str, generation: str, columns: list[str], strict: bool = True, multiline: bool = True
) -> DataFrame:
    """Rows of quoted CSV files with a header, all text, with ``generation`` and ``src_ord``.

    Quoted commas, line breaks, doubled quotes and a byte-order mark are read
    as they should. A short row is padded with nulls. A row with more fields
    than the header is an error if ``strict``, and dropped otherwise: Spark
    marks short and long rows alike, and only a long one has a last column.
    A file whose fields hold line breaks can't be split, so it is one task;
    without such fields, ``multiline=False`` lets Spark split it.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    long = F.col(CORRUPT).isNotNull() & F.col(columns[-1]).isNotNull()
    if strict:
        bad = rows.select(F.when(long, F.lit(1)).alias("bad")).filter("bad = 1").limit(1).count()
        if bad:
            raise ValueError(f"{path}: a row has more fields than the header")
    kept = with_source_order(rows).filter(~long).drop(CORRUPT)
    return kept.withColumn("generation", F.lit(generation))


def with_source_order(df: DataFrame) -> DataFrame:
    """Adds ``src_ord``, which follows the order of the input: files by path, then rows as they stand. Call it right at the scan.

    Spark packs files and parts of files into tasks by size. A task reads a
    part in order, so a part's place in its file and the row's in the task
    order all rows: twice the place, because a part has fewer rows than bytes.
    """
    files = sorted(f.replace(":///", ":/") for f in df.inputFiles())
    if len(files) > 1 << 20:
        raise ValueError("more than 2**20 files")
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "_n long, _file string")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = F.col("_metadata.file_block_start") * 2 + row
    placed = df.select("*", F.replace("_metadata.file_path", F.lit(":///"), F.lit(":/")).alias("_file"), at.alias("_at"))
    numbered = placed.join(F.broadcast(numbers), "_file", "left")
    missing = F.raise_error(F.lit("a row of a file that the table does not list"))
    order = F.coalesce("_n", missing.cast("long")) * F.lit(1 << 43) + F.col("_at")
    return numbered.select(*df.columns, order.alias("src_ord"))


def with_row_index(df: DataFrame) -> DataFrame:
    """Adds ``src_ord`` to rows of Parquet files: struct(file, row), the file's path and the row's own number in it.

    It compares as :func:`with_source_order` does, files by path, then rows as
    they stand, however Spark cuts files into tasks. The number comes from the
    file, so no list of files is made and nothing is broadcast. Call it right
    at the scan.
    """
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select("*", order.alias("src_ord"))


def with_raw_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds ``raw_row``: the source row as JSON, nulls kept."""
    return df.withColumn("raw_row", F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}))


def write_records(df: DataFrame, path: str) -> None:
    """One nested JSON object for each row."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_problems(problems: DataFrame, summary: DataFrame, path: str) -> None:
    """Rejected rows and the one-row summary, side by side."""
    problems.write.json(f"{path}/problems")
    summary.write.json(f"{path}/summary")


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_narrow(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a Parquet table; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def lookup_by_key(df: DataFrame, column: str, value) -> DataFrame:
    """The row with a key, if there is one; several are an error. The filter reaches the scan."""
    rows = df.filter(F.col(column) == F.lit(value))
    if rows.limit(2).count() > 1:
        raise ValueError(f"{column} = {value!r} is held by several rows")
    return rows


def export_linked(candidates: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Linked candidates with their event's columns and sorted sources, an empty array for none."""
    own = nested_sources(sources.select("event_slug", "source_type", "external_record_id", "url"))
    c = candidates.filter("linked_event_id is not null").select(
        "candidate_id", "same_incident_id", F.col("status").alias("candidate_status"), "linked_event_id"
    )
    e = events.drop("candidate_id").withColumn("linked_event_id", F.col("slug")).withColumn("event_exists", F.lit(True))
    out = c.join(e, "linked_event_id", "left").join(own.withColumnRenamed("event_slug", "linked_event_id"), "linked_event_id", "left")
    return out.withColumns(
        {
            "event_exists": F.coalesce("event_exists", F.lit(False)),
            "sources": F.coalesce("sources", F.array().cast(own.schema["sources"].dataType)),
        }
    )
