"""The latest record at or before each row's time, for record logs of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .skew import CHUNK_ROWS, hot_chunks, hot_keys


def as_of(
    rows: DataFrame, records: DataFrame, ts: str, at: str, *, order: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS,
    out: str = "record",
) -> DataFrame:
    """Add ``out``, the record (a struct) with the greatest ``at`` that is not above ``ts``; NULL if there is none.

    Of records of one time, the last by ``order`` counts. Rows and records are put together and cut into time chunks by
    exact counts, so that bursts of either are spread. Each chunk is one sorted run, led by the last record of the
    chunks before it; the list that finds these has one row per chunk. No row meets more than one record, and nothing is
    broadcast but the chunks' widths. ``rows`` is read three times, twice only for its times. Rows without a time have no
    record, records without one are in force at no time. Rows of one nanosecond are in one chunk.
    """
    timed = rows.where(F.col(ts).isNotNull())
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    both = timed.select(F.lit(0).alias("_log"), F.col(ts).alias("_at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")).unionByName(
        records.where(F.col(at).isNotNull()).select(
            F.lit(0).alias("_log"), F.col(at).alias("_at"), whole.alias("_record"),
            F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in order]).alias("_order")),
        allowMissingColumns=True)
    cut = {"min_chunk_ns": 1, "chunk_rows": chunk_rows}
    one = hot_keys(both.select("_log", "_at"), ["_log"], "_at", hot_rows=0, **cut)
    chunked = hot_chunks(both, one, ["_log"], "_at", **cut)
    last = F.max_by("_record", F.when(F.col("_record").isNotNull(), F.struct("_at", "_order")))
    ends = chunked.groupBy("_log", "_chunk").agg(last.alias("_record"))
    earlier = Window.partitionBy("_log").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    leads = ends.withColumn("_record", F.last("_record", ignorenulls=True).over(earlier)).withColumn("_lead", F.lit(True))
    led = chunked.withColumn("_lead", F.lit(False)).unionByName(leads, allowMissingColumns=True)
    # a record of a row's own time comes before it
    until = Window.partitionBy("_chunk").orderBy(
        F.desc("_lead"), "_at", F.col("_row").isNotNull(), "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = led.withColumn(out, F.last("_record", ignorenulls=True).over(until)).where("_row IS NOT NULL")
    without = rows.where(F.col(ts).isNull())
    return found.select("_row.*", out).unionByName(without, allowMissingColumns=True)
