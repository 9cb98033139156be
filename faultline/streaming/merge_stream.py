"""Merges fed by a stream: each micro-batch goes through the same guarded merge as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def merge_stream(
    stream: DataFrame,
    read: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
) -> DataStreamWriter:
    """A stream writer that merges each micro-batch into the snapshot that ``read`` gives.

    ``write(snapshot, batch)`` must put the snapshot at a new place named by
    the batch and then make it current. A batch that comes again after a
    failure merges into the same result, because the merges change nothing
    the second time.
    """

    def one(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch).drop("action"), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
