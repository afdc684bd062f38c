"""The rate check on a stream: the open window of each key is its state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bits import monotonic_to_timestamp
from ..operators.ratelimit import open_windows, rate_check
from ..schemas import RATE_THRESHOLD, RATE_WINDOW_NS
from ..session import remove_folder


# Micro-batches from one that writes all keys' windows to the next.
SNAPSHOT_EVERY = 20


def rate_batches(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ts: str, order: Sequence[str], *,
    window_ns: int = RATE_WINDOW_NS, threshold: int = RATE_THRESHOLD, trigger: dict | None = None,
    lateness_ns: int | None = None, **check_options,
) -> StreamingQuery:
    """Run ``rate_check`` on each micro-batch, going on from the windows the one before left open.

    For streams with hot keys: a micro-batch is shuffled, sorted and cut into chunks like a batch, so no key's rows are
    held in memory. Rows go to ``path/rows/batch_id=N``, the windows of the keys that came to ``path/open/batch_id=N``; a
    repeated micro-batch replaces both. Every ``SNAPSHOT_EVERY``-th writes the windows of all keys, and folders from
    before the last such snapshot are removed with the next. All keys keep their last window, so one wrong clock reading
    changes no other key. With ``lateness_ns``, a snapshot leaves out windows that ended so long before the 99th
    percentile of its micro-batch's times; state then stays bounded, and rows later than that may open a new window.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        opened = _open_before(spark, path, batch_id, keys)
        checked = rate_check(
            batch, keys, ts, order, window_ns=window_ns, threshold=threshold, opened=opened, **check_options
        ).withColumn("late", F.col(ts) < F.col("window_start"))
        rows = f"{path}/rows/batch_id={batch_id}"
        checked.write.mode("overwrite").parquet(rows)
        written = spark.read.schema(checked.schema).parquet(rows)
        whole = batch_id % SNAPSHOT_EVERY == 0
        left = open_windows(written, keys, opened=opened if whole else None)
        if whole and lateness_ns is not None:
            now = written.agg(F.percentile_approx(ts, 0.99)).scalar()
            left = left.where(now.isNull() | (F.col("window_start") + window_ns + lateness_ns >= now))
        left.write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")
        if whole:
            last = batch_id - SNAPSHOT_EVERY
            for old in range(max(0, last - SNAPSHOT_EVERY), last):
                remove_folder(spark, f"{path}/open/batch_id={old}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _open_before(spark: SparkSession, path: str, batch_id: int, keys: Sequence[str]) -> DataFrame | None:
    """Each key's last window before a micro-batch: of the last snapshot and what came since. None for the first."""
    if batch_id == 0:
        return None
    since = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    folders = [f"{path}/open/batch_id={n}" for n in range(since, batch_id)]
    windows = spark.read.option("basePath", f"{path}/open").parquet(*folders)
    last = windows.groupBy(*keys).agg(F.max_by(F.struct("window_start", "n"), "batch_id").alias("_last"))
    return last.select(*keys, "_last.*")


def rate_stream(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], *, window_ns: int = RATE_WINDOW_NS,
    threshold: int | Column = RATE_THRESHOLD, lateness: str | None = None, boot_ns: int = 0,
) -> DataFrame:
    """Add ``window_start``, ``n``, ``limited`` and ``late`` to a stream; equal to ``rate_check`` for ordered input.

    The rows a key has in one micro-batch are held and sorted together, so bound the micro-batch at its source, or use
    ``rate_batches`` where one key may hold much of it. A row
    from before the open window counts in that window and is flagged ``late``. With ``lateness`` (such as
    ``"10 minutes"``) a key idle for a window is forgotten, which changes nothing since its next row would open a new
    window; Spark then discards rows later than ``lateness``.

    ``ts`` and ``order`` are non-NULL. Other numeric columns travel as text: pandas holds a numeric column with NULLs
    as floats, which would round large integers.
    """
    keys, order = list(keys), list(order)
    as_text = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (ts, *order)
    ]
    carried = [f"_text_{name}" if name in as_text else name for name in df.columns]
    rows = df.withColumns({f"_text_{name}": F.col(name).cast("string") for name in as_text})
    out = T.StructType([
        *[rows.schema[name] for name in carried], T.StructField("window_start", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("late", T.BooleanType()),
    ])
    expires = lateness is not None
    timeout = GroupStateTimeout.NoTimeout
    if expires:
        timed = rows.withColumn("_event_time", monotonic_to_timestamp(ts, boot_ns))
        rows, timeout = timed.withWatermark("_event_time", lateness), GroupStateTimeout.EventTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(batches), ignore_index=True).sort_values([ts, *order], kind="stable")
        start, count = state.get if state.exists else (None, 0)
        starts, counts, lates = [], [], []
        for t in batch[ts].tolist():
            lates.append(start is not None and t < start)
            if start is None or t - start > window_ns:
                start, count = t, 1
            else:
                count += 1
            starts.append(start)
            counts.append(count)
        state.update((start, count))
        if expires:
            idle_ms = (max(start, t) + window_ns + boot_ns) // 1_000_000 + 1
            state.setTimeoutTimestamp(max(idle_ms, state.getCurrentWatermarkMs() + 1))
        yield batch[carried].assign(window_start=starts, n=counts, late=lates)

    scanned = rows.groupBy(*keys).applyInPandasWithState(
        step, out, "start BIGINT, count BIGINT", "append", timeout
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    scanned = scanned.select(
        *[F.col(f"_text_{name}").cast(types[name]).alias(name) if name in as_text else name for name in df.columns],
        "window_start", "n", "late",
    )
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scanned.withColumn("limited", F.col("n") > limit)
