"""Tuning records: which one is in force at a row's time, and the sampling it asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import TUNING_DEFAULTS
from .asof import as_of
from .sizes import BROADCAST_ROWS, broadcast_if_small
from .skew import CHUNK_ROWS

DAY_NS = 86_400_000_000_000
# Records that are ordered in one task.
MAX_RECORDS = 100_000


def tuning_in_force(
    df: DataFrame, tuning: DataFrame, *, ts: str = "ts_ns", order: Sequence[str] = ("effective_ns", "version"),
    bucket_ns: int = DAY_NS, max_records: int = MAX_RECORDS, max_broadcast: int = BROADCAST_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``version, max_rate_pps, sampling_num, sampling_den`` of the latest record at or before ``ts``.

    Before the first record the defaults apply. A record too short to decode (a NULL version) changes nothing.

    ``tuning`` is counted first. With up to ``max_records`` records, an operator's change log, they are ordered in one
    task, and each interval between two of them is listed under the time buckets it touches: an equality join on the bucket
    with a range test, in which every row meets exactly one interval. The last record has no end and is read as a scalar.
    The listed intervals are counted and broadcast up to ``max_broadcast`` rows, else joined by shuffle. A longer log is
    merged with the rows by time, see ``as_of``; that shuffles the rows.
    """
    names = list(TUNING_DEFAULTS)
    tuning = tuning.where("version IS NOT NULL")
    if tuning.count() > max_records:
        known = tuning.select(*dict.fromkeys([*order, "effective_ns", *names]))
        met = as_of(df, known, ts, "effective_ns", order=order, chunk_rows=chunk_rows, out="_record")
        return met.select(*df.columns, *[
            F.coalesce(F.col(f"_record.{name}"), F.lit(default)).cast("bigint").alias(name)
            for name, default in TUNING_DEFAULTS.items()
        ])
    in_order = Window.orderBy(*order)
    intervals = tuning.select("effective_ns", *names, F.lead("effective_ns").over(in_order).alias("_until"))
    closed = intervals.where(F.col("_until") > F.col("effective_ns"))
    listed = closed.select(
        F.col("effective_ns").alias("_from"), "_until", F.struct(*names).alias("_set"),
        F.explode(
            F.sequence(
                _bucket(F.col("effective_ns"), bucket_ns), _bucket(F.col("_until") - 1, bucket_ns), F.lit(bucket_ns)
            )
        ).alias("_bucket"),
    )
    last = tuning.agg(F.max_by(F.struct("effective_ns", *names), F.struct(*order))).scalar()

    rows = df.withColumns({"_at": _bucket(F.col(ts), bucket_ns), "_last": last})
    in_interval = (
        (F.col("_at") == F.col("_bucket")) & (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_until"))
    )
    joined = rows.join(broadcast_if_small(listed, max_broadcast), in_interval, "left")
    is_last = F.col(ts) >= F.col("_last.effective_ns")
    return joined.select(*df.columns, *[
        F.coalesce(F.when(is_last, F.col(f"_last.{name}")), F.col(f"_set.{name}"), F.lit(default))
        .cast("bigint").alias(name)
        for name, default in TUNING_DEFAULTS.items()
    ])


def _bucket(ts: Column, bucket_ns: int) -> Column:
    return (ts - F.pmod(ts, F.lit(bucket_ns))).cast("bigint")


def sample(
    df: DataFrame, *, seq: str = "seq", num: Column | int | str = "sampling_num", den: Column | int | str = "sampling_den"
) -> DataFrame:
    """Keep ``num`` of every ``den`` rows by sequence number. Deterministic; a denominator below 1 keeps nothing."""
    over = F.lit(den) if isinstance(den, int) else F.col(den) if isinstance(den, str) else den
    under = F.lit(num) if isinstance(num, int) else F.col(num) if isinstance(num, str) else num
    place = F.pmod(F.col(seq), F.when(over > 0, over))
    return df.where(place < under)
