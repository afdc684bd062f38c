"""Tuning records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.bits import u_le
from ..schemas import TUNING, TUNING_DEFAULTS


def tuning_record(
    spark: SparkSession, effective_ns: int, *, version: int = 1, rate_limit: int = 1000, sampling_num: int = 1,
    sampling_den: int = 1,
) -> DataFrame:
    """One record, to append to a tuning table."""
    return spark.createDataFrame([(effective_ns, version, rate_limit, sampling_num, sampling_den)], TUNING)


def decode_tuning(records: DataFrame, *, record: str = "record") -> DataFrame:
    """Five little-endian u32: version, max_rate_pps, (unused), sampling_num, sampling_den. Short records are NULL."""
    whole = F.octet_length(record) >= 20
    fields = {"version": 0, "max_rate_pps": 4, "sampling_num": 12, "sampling_den": 16}
    decoded = records.withColumns({name: F.when(whole, u_le(record, at, 4)) for name, at in fields.items()})
    return decoded.drop(record)


def latest_tuning(tuning: DataFrame, *, by: Sequence[str] = (), order: Sequence[str] = ("effective_ns", "seq")):
    """The last record (per ``by`` key); with no key and no record, one row of defaults."""
    usable = tuning.where(F.col("version").isNotNull())
    last = usable.groupBy(*by).agg(F.max_by(F.struct(*TUNING_DEFAULTS), F.struct(*order)).alias("_last"))
    return last.select(*by, *[
        F.coalesce(F.col(f"_last.{name}"), F.lit(default)).cast("bigint").alias(name)
        for name, default in TUNING_DEFAULTS.items()
    ])
