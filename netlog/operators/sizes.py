"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a few numbers each: tens of megabytes at most.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; otherwise as it is, to be joined by shuffle.

    Runs one count of ``df``. For control tables whose size neither their keys nor their statistics bound.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
