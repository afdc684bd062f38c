"""What one micro-batch leaves for the next: a small table in one of two folders, written anew each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

_BATCH = "_batch_id"


def write_carry(rows: DataFrame, path: str, batch_id: int) -> None:
    """Keep ``rows`` for the micro-batch after ``batch_id``. A repeated micro-batch replaces them.

    Micro-batches take two folders in turn. What the one before left is untouched until this one is done, so it can be
    read again if this one is repeated; what older ones left is gone.
    """
    rows.withColumn(_BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(_folder(path, batch_id))


def read_carry(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    """What the micro-batch before ``batch_id`` left; nothing for the first. Raises if that folder has another one's rows."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(StructType([*schema.fields]).add(_BATCH, LongType())).parquet(_folder(path, batch_id - 1))
    other = found.where(F.col(_BATCH) != batch_id - 1).select(_BATCH).first()
    if other is not None:
        raise ValueError(f"{path} holds rows of micro-batch {other[0]}, not of {batch_id - 1}")
    return found.drop(_BATCH)


def last_carry(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """What the latest micro-batch left, for readers outside the stream."""
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields]).add(_BATCH, LongType()))
    found = reader.parquet(path).drop("turn")
    return found.where(F.col(_BATCH) == found.agg(F.max(_BATCH)).scalar()).drop(_BATCH)


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/turn={batch_id % 2}"
