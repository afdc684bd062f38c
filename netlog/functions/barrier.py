"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` so that later filters on them do not compute them again.

    The optimizer moves a filter below the projection that defines its column and repeats the definition there; for a
    long derivation such as a header decode or a parse, that repeats the work many times over. It does not move a
    filter below a generator that produces the column, so the columns come out of a one-element ``inline``. The rows
    stay in place: no shuffle, and the generator is part of the compiled stage.
    """
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    others = [c for c in df.columns if c not in columns]
    return df.withColumn("_made", made).select(*others, F.inline(F.array("_made")))
