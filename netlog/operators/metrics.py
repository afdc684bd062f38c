"""Counts by reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def reason_counts(df: DataFrame, reason: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Rows per reason. Counted per task first, so the shuffle carries one row per reason and task."""
    return df.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("rows"))


def drop_total(verdicts: DataFrame) -> DataFrame:
    """The single drop counter: flows over their rate."""
    return verdicts.agg(F.count_if(F.col("edge_reason") == "rate_limited").alias("dropped"))


def stage_counts(logs: DataFrame) -> DataFrame:
    """Rows that reached the parser, were accepted, or were rejected there or before it."""
    before = F.col("reject_reason").isin("short_record", "bad_ref", "bad_inline_len", "short_payload", "delegated_large")
    return logs.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(before).alias("structural_drops"),
        F.count_if(F.col("reject_reason").isNotNull() & ~before).alias("parser_drops"),
    )


def observe_rejects(logs: DataFrame, name: str = "netlog") -> DataFrame:
    """The same counts as observed metrics, for a query that writes its rows anyway or for a stream's progress."""
    return logs.observe(
        name,
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
    )
