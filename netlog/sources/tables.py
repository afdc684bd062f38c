"""Table sources for batch and streams, and the log sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_FILES_PER_TRIGGER = 1000


def read_table_stream(
    spark: SparkSession, path: str, schema: str, *, max_files: int = MAX_FILES_PER_TRIGGER
) -> DataFrame:
    """New Parquet files of a folder. ``max_files`` bounds a micro-batch, which is how overload is absorbed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def log_lines(logs: DataFrame) -> DataFrame:
    """``value`` and ``channel``: the document in ``logs``, or the event with its reason and bytes in ``rejects``.

    A reject keeps whatever names it and its bytes: those to parse, or those it came with (``raw``).
    """
    names = ("seq", "ts_ns", "source", "conn_id", "pid", "tid", "is_ref", "payload_ref", "data_len", "reject_reason")
    known = [c for c in names if c in logs.columns]
    held = F.col("data").cast("binary")
    held = F.coalesce(held, F.col("raw")) if "raw" in logs.columns else held
    reject = F.struct(*known, F.base64(held).alias("data"))
    accepted = F.col("doc").isNotNull()
    return logs.select(
        F.when(accepted, F.to_json("doc")).otherwise(F.to_json(reject)).alias("value"),
        F.when(accepted, "logs").otherwise("rejects").alias("channel"),
    )


def write_logs(logs: DataFrame, path: str) -> None:
    """One JSON object per line, accepted and rejected apart, in one pass. Writing the same path again replaces it."""
    log_lines(logs).write.mode("overwrite").partitionBy("channel").text(path)
