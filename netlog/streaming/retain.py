"""The latest rows of a stream, in all or of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.payloads import retain_latest
from .carry import last_carry, read_carry, write_carry


def retain_batches(
    stream: DataFrame, path: str, checkpoint: str, n: int, *, by: Sequence[str] = (), order: Sequence[str] = ("ts_ns", "seq"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the latest ``n`` rows of a stream (per ``by`` key) in ``path``; :func:`retained` reads them.

    The latest of a part and of what was kept before are the latest of all, so a micro-batch meets no more than ``n`` kept
    rows (per key). What is kept is a carry table, written anew by each micro-batch that has rows.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        kept = read_carry(batch.sparkSession, path, batch_id, batch.schema)
        write_carry(retain_latest(batch.unionByName(kept), n, by=by, order=order), path, batch_id)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def retained(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the last micro-batch of :func:`retain_batches` kept."""
    return last_carry(spark, path)
