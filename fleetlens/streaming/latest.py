"""Keeping the latest state of a stream of snapshots.

Each trigger folds its rows to the newest per key and writes them to a folder named after
the batch. A batch that is run again overwrites its own folder, so nothing counts twice.
Readers fold the folders again, which gives the batch answer whatever the cut into
batches was. No state is held between triggers; ``compact`` folds old folders into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetlens import fixed
from fleetlens.operators.latest import latest_by


def _batch_path(sink: str, batch: int) -> str:
    return f"{sink.rstrip('/')}/batch={batch}"


def stream_latest(
    stream: DataFrame,
    keys: Sequence[str],
    seq: str,
    sink: str,
    checkpoint: str,
    every_seconds: int | None = fixed.DEFAULT_REFRESH_SECONDS,
) -> StreamingQuery:
    """Starts folding ``stream`` into ``sink``; ``every_seconds=None`` works off what is there and stops."""

    def fold(rows: DataFrame, batch: int) -> None:
        latest_by(rows, keys, seq).write.mode("overwrite").parquet(_batch_path(sink, batch))

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    if every_seconds is None:
        return writer.trigger(availableNow=True).start()
    if every_seconds not in fixed.REFRESH_SECONDS:
        raise ValueError(f"refresh every {every_seconds}s is not offered; choose from {fixed.REFRESH_SECONDS}")
    return writer.trigger(processingTime=f"{every_seconds} seconds").start()


def read_latest(spark: SparkSession, sink: str, keys: Sequence[str], seq: str) -> DataFrame:
    """The newest row per key over all batches so far."""
    return latest_by(spark.read.parquet(sink).drop("batch"), keys, seq)


def compact(spark: SparkSession, sink: str, into: str, keys: Sequence[str], seq: str) -> None:
    """Folds a sink into the first folder of a new one.

    Stop the stream, compact, and start it again with the same checkpoint and ``into`` as its
    sink: batch numbers go on, and a batch that was cut off is written to the new sink. The
    old folders are left alone, so readers of them are not disturbed.
    """
    read_latest(spark, sink, keys, seq).write.mode("errorifexists").parquet(_batch_path(into, -1))
