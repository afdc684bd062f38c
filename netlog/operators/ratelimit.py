"""Per-key rate check with an anchored window.

The first row of a key opens a window at its own time. A row more than ``window_ns`` after the window's start opens a
new one; any other row adds to the count and is limited when the count exceeds the threshold. Each start depends on
the one before, so this is a scan in time order, not a fixed bucket, and it is the one batch operator in Python.

Plan: one shuffle by key, one sort, one streaming scan that holds a start and a count. A hot key is cut into time
chunks which are scanned in parallel:

1. each chunk is summarised as a step function from the window it may be entered with to the window it leaves with;
2. the summaries of a key, not its rows, are walked in order, which gives every chunk its entry window;
3. the entry windows join the rows as one leading row per chunk, without a time, in the main shuffle.

A chunk lasts at least ``CHUNK_WINDOWS`` windows, and a summary has at most as many steps as one window has rows, so
step 2 reads at most ``1 / CHUNK_WINDOWS`` of the rows even if no two steps meet. A key that has a chunk of over
``BURST_ROWS`` rows, because they crowd into few windows, is cut finer than windows are long: see ``bursts``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import RATE_THRESHOLD, RATE_WINDOW_NS
from .bursts import burst_entries
from .skew import CHUNK_ROWS, HOT_ROWS, hot_chunks, hot_keys, same_key

CHUNK_WINDOWS = 64
BURST_ROWS = 4_000_000
_FOREVER = 2**63 - 1
_FIRST_CHUNK = -(2**63)


def rate_check(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], *, window_ns: int = RATE_WINDOW_NS,
    threshold: int | Column = RATE_THRESHOLD, hot_rows: int | None = HOT_ROWS, chunk_rows: int = CHUNK_ROWS,
    chunk_windows: int = CHUNK_WINDOWS, burst_rows: int = BURST_ROWS, opened: DataFrame | None = None,
) -> DataFrame:
    """Add ``window_start``, ``n`` (place in the window) and ``limited`` to every row.

    ``ts`` is a non-NULL BIGINT; ``order`` breaks ties. ``threshold`` may be a column. One job first counts the rows of
    each key. If none has more than ``hot_rows``, that is all besides the scan itself; else a second job looks for
    chunks of more than ``burst_rows`` rows, and the hot keys' rows are read twice more. So give ``df`` as a table rather
    than a long derivation. ``hot_rows=None`` skips all that and keeps every key in one task.

    ``opened`` continues from earlier rows: one row per key with ``window_start`` and ``n`` of its last window, as
    ``open_windows`` gives. A row from before that window counts in it.
    """
    keys, order = list(keys), list(order)
    parts, hot = [], None
    min_chunk_ns = window_ns * chunk_windows
    if hot_rows is not None:
        listed = hot_keys(df, keys, ts, min_chunk_ns=min_chunk_ns, hot_rows=hot_rows, chunk_rows=chunk_rows)
        if found := listed.collect():
            hot = df.sparkSession.createDataFrame(found, listed.schema)
    if hot is None:
        rows = df.withColumn("_chunk", F.lit(None).cast("bigint"))
        if opened is not None:
            parts.append(opened.select(*keys, F.lit(None).cast("bigint").alias("_chunk"), *_as_entry()))
    else:
        rows = hot_chunks(df, hot, keys, ts, min_chunk_ns=min_chunk_ns, chunk_rows=chunk_rows)
        crowded = rows.where("_chunk IS NOT NULL").groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
        sizes = crowded.groupBy(*keys).agg(F.sum("_rows").alias("_rows"), F.max("_rows").alias("_most"))
        bursting = sizes.where(F.col("_most") > burst_rows).drop("_most")
        if found := bursting.collect():
            bursting = df.sparkSession.createDataFrame(found, bursting.schema)
            listed = F.broadcast(bursting.select(*[F.col(k).alias(f"_crowd_{k}") for k in keys]))
            crowd = df.join(listed, same_key(keys, "_crowd_"), "left_semi")
            crowd, entries = burst_entries(
                crowd, bursting, keys, ts, window_ns=window_ns, chunk_rows=chunk_rows, opened=opened)
            parts += [crowd.withColumns(_no_entry()), entries]
            rows = rows.join(listed, same_key(keys, "_crowd_"), "left_anti")
            if opened is not None:
                opened = opened.join(listed, same_key(keys, "_crowd_"), "left_anti")
        later = rows.where(F.col("_chunk").isNotNull())
        if opened is not None:
            # a hot key's rows up to the end of its open window are one chunk; what follows is independent of it
            known = opened.join(F.broadcast(hot), same_key(keys, "_hot_"), "left")
            first = F.when(F.col("_width").isNotNull(), _FIRST_CHUNK)
            parts.append(known.select(*keys, first.cast("bigint").alias("_chunk"), *_as_entry()))
            ends = known.where("_width IS NOT NULL").select(
                *[F.col(k).alias(f"_open_{k}") for k in keys], (F.col("window_start") + window_ns).alias("_open_until")
            )
            in_open = F.col("_chunk").isNotNull() & (F.col(ts) <= F.col("_open_until"))
            rows = rows.join(F.broadcast(ends), same_key(keys, "_open_"), "left").select(
                *df.columns, F.when(in_open, _FIRST_CHUNK).otherwise(F.col("_chunk")).alias("_chunk")
            )
            later = rows.where(F.col("_chunk") > _FIRST_CHUNK)
        parts.append(_entry_windows(later, keys, ts, window_ns))
    marked = rows.withColumns(_no_entry())
    for part in parts:
        marked = marked.unionByName(part, allowMissingColumns=True)

    kept = T.StructType(df.schema.fields)
    out = T.StructType([
        *kept.fields, T.StructField("window_start", T.LongType()), T.StructField("n", T.LongType())
    ])
    scanned = (
        marked.repartition(*keys, "_chunk")
        .sortWithinPartitions(*keys, "_chunk", F.col(ts).asc_nulls_first(), *order)
        .mapInArrow(_scan_windows(keys, ts, df.columns, window_ns), out)
    )
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scanned.withColumn("limited", F.col("n") > limit)


def open_windows(
    checked: DataFrame, keys: Sequence[str], *, opened: DataFrame | None = None
) -> DataFrame:
    """The last window of every key, ``keys, window_start, n``, to go on from: of ``checked`` rows and before them."""
    windows = checked.select(*keys, "window_start", "n")
    if opened is not None:
        windows = windows.unionByName(opened.select(*keys, "window_start", "n"))
    per_window = windows.groupBy(*keys, "window_start").agg(F.max("n").alias("n"))
    return per_window.groupBy(*keys).agg(
        F.max_by("n", "window_start").alias("n"), F.max("window_start").alias("window_start")
    ).select(*keys, "window_start", "n")


def _as_entry() -> list[Column]:
    return [F.col("window_start").alias("_entry_start"), F.col("n").alias("_entry_count")]


def _no_entry() -> dict[str, Column]:
    return {"_entry_start": F.lit(None).cast("bigint"), "_entry_count": F.lit(None).cast("bigint")}


def _entry_windows(rows: DataFrame, keys: list[str], ts: str, window_ns: int) -> DataFrame:
    """One row per chunk of a hot key, except its first, with the window that is open when the chunk begins."""
    key_fields = [rows.schema[k] for k in keys]

    def schema(*names: str) -> T.StructType:
        return T.StructType([*key_fields, *[T.StructField(n, T.LongType()) for n in ("_chunk", *names)]])

    exits = (
        rows.select(*keys, "_chunk", ts)
        .repartition(*keys, "_chunk")
        .sortWithinPartitions(*keys, "_chunk", ts)
        .mapInArrow(_chunk_exits(keys, ts, window_ns), schema("_upto", "_exit_start", "_exit_count"))
    )
    return (
        exits.repartition(*keys)
        .sortWithinPartitions(*keys, "_chunk", "_upto")
        .mapInArrow(_walk_exits(keys, window_ns), schema("_entry_start", "_entry_count"))
    )


def _group_starts(batch: pa.RecordBatch, names: list[str], previous: tuple | None) -> tuple[np.ndarray, tuple]:
    """Flags of the rows whose ``names`` differ from the row before, and the last row's values."""
    n = batch.num_rows
    changed = np.zeros(n, dtype=bool)
    for name in names:
        col = batch.column(name)
        ahead, behind = col.slice(1), col.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(ahead, behind), False)
        differs = pc.or_(differs, pc.xor(pc.is_null(ahead), pc.is_null(behind)))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    first = tuple(batch.column(name)[0].as_py() for name in names)
    changed[0] = first != previous
    return changed, tuple(batch.column(name)[n - 1].as_py() for name in names)


def _scan_windows(keys: list[str], ts: str, kept: list[str], window_ns: int):
    names = [*keys, "_chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, start, count = None, 0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            is_first, previous = _group_starts(batch, names, previous)
            entry = batch.column("_entry_start")
            is_row = pc.is_null(entry)
            if pc.any(pc.and_(is_row, pc.is_null(batch.column(ts)))).as_py():
                raise ValueError(f"column {ts!r} has NULLs")
            times = pc.fill_null(batch.column(ts), 0).to_numpy().tolist()
            starts, counts = [], []
            if entry.null_count == batch.num_rows:
                for first, t in zip(is_first.tolist(), times):
                    if first or t - start > window_ns:
                        start, count = t, 1
                    else:
                        count += 1
                    starts.append(start)
                    counts.append(count)
            else:
                carried = zip(entry.to_pylist(), batch.column("_entry_count").to_pylist())
                for first, t, (entry_start, entry_count) in zip(is_first.tolist(), times, carried):
                    if entry_start is not None:
                        start, count = entry_start, entry_count
                    elif first or t - start > window_ns:
                        start, count = t, 1
                    else:
                        count += 1
                    starts.append(start)
                    counts.append(count)
            columns = [batch.column(name) for name in kept]
            out = pa.RecordBatch.from_arrays(
                [*columns, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=[*kept, "window_start", "n"],
            )
            yield out.filter(is_row)

    return run


class _ChunkSummary:
    """Windows a chunk can be left with, by the row that restarts the window on the way in.

    Row ``i`` is such a first row if it lies less than one window into the chunk, or is the first row after that.
    From each one a chain of windows runs through the chunk. Neighbouring chains merge when they restart on the same
    row; ``upto`` is then the time of the last first row of the run.
    """

    def __init__(self, chunk: int, window_ns: int):
        self.window_ns = window_ns
        self.open_until = chunk + window_ns
        self.closed = False
        self.rows = 0
        self.upto = np.empty(0, dtype=np.int64)
        self.start = np.empty(0, dtype=np.int64)
        self.base = np.empty(0, dtype=np.int64)  # rows of the chunk before the window's first row

    def add(self, times: np.ndarray) -> None:
        if not self.closed:
            n_open = int(np.searchsorted(times, self.open_until, side="left"))
            self.closed = n_open < len(times)
            firsts, at = np.unique(times[: n_open + 1], return_index=True)
            if len(self.upto) and len(firsts) and firsts[0] == self.upto[-1]:
                firsts, at = firsts[1:], at[1:]
            self.upto = np.concatenate([self.upto, firsts])
            self.start = np.concatenate([self.start, firsts])
            self.base = np.concatenate([self.base, self.rows + at])
        # an early chain may be one window ahead of a late one, so the due ones are not always a prefix
        due = np.flatnonzero(self.start < times[-1] - self.window_ns)
        while len(due):
            at = np.searchsorted(times, self.start[due] + self.window_ns, side="right")
            self.start[due] = times[at]
            self.base[due] = self.rows + at
            last_of_run = np.append(self.start[:-1] != self.start[1:], True)
            self.upto, self.start, self.base = (
                self.upto[last_of_run], self.start[last_of_run], self.base[last_of_run]
            )
            due = np.flatnonzero(self.start < times[-1] - self.window_ns)
        self.rows += len(times)

    def exits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``upto``, exit start, exit count, and whether the start is NULL: the last row stands for no restart."""
        no_restart = np.zeros(len(self.upto) + 1, dtype=bool)
        no_restart[-1] = True
        return (
            np.append(self.upto, _FOREVER), np.append(self.start, 0),
            np.append(self.rows - self.base, self.rows), no_restart,
        )


def _chunk_exits(keys: list[str], ts: str, window_ns: int):
    names = [*keys, "_chunk"]

    def emit(head: pa.RecordBatch, summary: _ChunkSummary) -> pa.RecordBatch:
        upto, start, count, no_restart = summary.exits()
        same = pa.array(np.zeros(len(upto), dtype=np.int64))
        return pa.RecordBatch.from_arrays(
            [*[head.column(name).take(same) for name in names],
             pa.array(upto), pa.array(start, mask=no_restart), pa.array(count)],
            names=[*names, "_upto", "_exit_start", "_exit_count"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = head = summary = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            is_first, previous = _group_starts(batch, names, previous)
            times = batch.column(ts).to_numpy()
            bounds = np.flatnonzero(is_first).tolist()
            if not bounds or bounds[0] != 0:
                bounds.insert(0, 0)
            for lo, hi in zip(bounds, [*bounds[1:], batch.num_rows]):
                if is_first[lo]:
                    if summary is not None:
                        yield emit(head, summary)
                    head = batch.slice(lo, 1)
                    summary = _ChunkSummary(head.column("_chunk")[0].as_py(), window_ns)
                summary.add(times[lo:hi])
        if summary is not None:
            yield emit(head, summary)

    return run


def _walk_exits(keys: list[str], window_ns: int):
    names = [*keys, "_chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous_key = previous_chunk = None
        start, count, bound, taken = None, 0, 0, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new_key, previous_key = _group_starts(batch, keys, previous_key)
            new_chunk, previous_chunk = _group_starts(batch, names, previous_chunk)
            entered, starts, counts = [], [], []
            steps = zip(
                new_key.tolist(), new_chunk.tolist(), batch.column("_upto").to_pylist(),
                batch.column("_exit_start").to_pylist(), batch.column("_exit_count").to_pylist(),
            )
            for i, (first_of_key, first_of_chunk, upto, exit_start, exit_count) in enumerate(steps):
                if first_of_key:
                    start = None
                if first_of_chunk:
                    taken = False
                    if start is not None:
                        entered.append(i)
                        starts.append(start)
                        counts.append(count)
                        bound = start + window_ns
                if not taken and (start is None or upto > bound):
                    taken = True
                    if exit_start is None:
                        count += exit_count
                    else:
                        start, count = exit_start, exit_count
            at = batch.take(pa.array(entered, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[at.column(name) for name in names], pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                names=[*names, "_entry_start", "_entry_count"],
            )

    return run
