"""Joins in which only the few hottest keys are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key is hot if it stands for more than this part of all rows. Fewer than HOT keys can be.
HOT = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row per ``keys``), of which ``size`` is how many rows each stands for.

    Groups of more than a HOT-th of ``total`` rows are fewer than HOT and are broadcast, so their rows stay where they
    are; all others meet by a shuffle, in which no key has more than that part. ``rows`` should be a written table.
    """
    hot = F.col(size) > F.lit(max(1, total // HOT))
    few = groups.where(hot)
    most = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.where(~hot), keys)
    return rows.join(F.broadcast(few), keys).unionByName(most)
