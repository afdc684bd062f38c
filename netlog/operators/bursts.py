"""Entry windows for keys whose rows crowd into few windows, by pointer doubling over "first row after the window".

Such a key cannot be cut into chunks of many windows: one window may hold most of its rows. Here it is cut by range into
pieces of about equally many distinct times, however short they are, and three facts make the scan parallel:

1. Within a piece, the chain of windows that begins at a time leaves the piece with a window that is found for all times
   at once, by doubling pointers to the first time after the window.
2. Where the chain goes on, the first time of a later piece after that window, is one lookup for each window that a piece
   can be left with: those that fall inside a piece meet its times there, in order.
3. From the first time of the key, the entries into all pieces are found by doubling these pointers: as many rounds as the
   number of pieces has binary digits. A chain enters a piece once at most, so the entries are as few as the pieces.

Counts follow from sums: rows before a piece, less rows before the window that is open when it begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import as_table, ensure_checkpoint_dir
from .skew import same_key

# In place of a piece's number: no time follows the window, or the one that does is known without looking into the piece.
AT_END, KNOWN = -1, -2
_LONGS = ("_t", "_rows", "_leave", "_leave_before")


def burst_entries(
    rows: DataFrame, bursting: DataFrame, keys: Sequence[str], ts: str, *, window_ns: int, chunk_rows: int,
    opened: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_chunk``, the number of their piece, and (keys, _chunk, _entry_start, _entry_count) of the pieces.

    ``rows`` are those of the keys in ``bursting`` (keys, _rows), of which ``_rows`` counts the rows; each key stands for
    a great many rows, so the list is short. A piece without an entry row begins with the key's first window. ``opened``
    (keys, window_start, n) has the windows that are open when the rows begin. Rows of one key and time are one piece.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark, "spark-warehouse/checkpoints")
    known = bursting.collect()
    numbered = spark.createDataFrame(
        [(*[r[k] for k in keys], i) for i, r in enumerate(known)],
        T.StructType([*[T.StructField(f"_burst_{k}", rows.schema[k].dataType) for k in keys], T.StructField("_key", T.LongType())]))
    numbered = F.broadcast(numbered)
    keyed = rows.join(numbered, same_key(keys, "_burst_"))
    n_pieces = max(1, -(-sum(r["_rows"] for r in known) // chunk_rows))

    times = keyed.where(F.col(ts).isNotNull()).groupBy("_key", F.col(ts).alias("_t")).agg(F.count(F.lit(1)).alias("_rows"))
    times = as_table(
        times.repartitionByRange(n_pieces, "_key", "_t").sortWithinPartitions("_key", "_t")
        .mapInArrow(_leave_pieces(window_ns), ", ".join(f"{c} BIGINT" for c in ("_key", "_piece", *_LONGS))), "rate-times")
    summed = times.groupBy("_key", "_piece").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum("_rows").alias("_rows"))
    in_order = Window.partitionBy("_key").orderBy("_piece")
    before = F.coalesce(F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = as_table(summed.withColumn("_before", before), "rate-pieces")
    cuts = {}
    for r in sorted(pieces.collect()):
        cuts.setdefault(r["_key"], []).append((r["_first"], r["_last"], r["_piece"]))
    cuts = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in cuts.items()})

    first = pieces.groupBy("_key").agg(F.min("_first").alias("_t"))
    left = times.select("_key", "_leave").distinct()
    started = None
    if opened is not None:
        started = opened.join(numbered, same_key(keys, "_burst_")).select("_key", F.col("window_start").alias("_leave"), "n")
        left = left.union(started.select("_key", "_leave"))
    onward = as_table(_onward(left, times, cuts, window_ns), "rate-onward")
    edges = times.select("_key", "_t", "_leave").join(onward, ["_key", "_leave"]).select("_key", "_t", "_to")
    if started is not None:
        begun = started.join(onward, ["_key", "_leave"]).select("_key", F.col("_to").alias("_t"))
        first = first.join(started.select("_key"), "_key", "left_anti").union(begun)
    # only times that a chain can come to are followed further
    nodes = onward.select("_key", F.col("_to").alias("_t")).union(first).distinct()
    entries = _reached(edges.join(nodes, ["_key", "_t"], "left_semi"), first, max(len(c[0]) for c in cuts.value.values()))

    left_with = entries.join(times, ["_key", "_t"]).select("_key", "_piece", F.col("_leave").alias("_start"), "_leave_before")
    windows = left_with.join(pieces, ["_key", "_piece"]).select(
        "_key", "_piece", "_start", (F.col("_before") + F.col("_leave_before")).alias("_base"))
    if started is not None:
        windows = windows.union(started.select("_key", F.lit(-1).cast("bigint"), "_leave", -F.col("n")))
    # the window open at a piece's beginning is that which the chain left an earlier piece with
    both = pieces.select("_key", "_piece", "_before").join(
        windows.withColumn("_open", F.struct("_start", "_base")).select("_key", "_piece", "_open"), ["_key", "_piece"], "full")
    met = both.withColumn("_open", F.last("_open", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    led = met.where("_before IS NOT NULL AND _open IS NOT NULL").join(numbered, "_key").select(
        *[F.col(f"_burst_{k}").alias(k) for k in keys], F.col("_piece").alias("_chunk"), F.col("_open._start").alias("_entry_start"),
        (F.col("_before") - F.col("_open._base")).alias("_entry_count"))

    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_chunk", T.LongType())])
    return keyed.select(*columns, "_key").mapInArrow(_piece_of(cuts, ts, columns), schema), led


def _leave_pieces(window_ns: int):
    """Of sorted (key, time, rows): the window that a chain from each time leaves the task's piece with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        key, times, rows = (table.column(i).to_numpy() for i in range(3))
        bounds = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own, counts = times[lo:hi], rows[lo:hi]
            place = np.arange(hi - lo)
            after = np.searchsorted(own, own + window_ns, "right")
            last = np.where(after < len(own), after, place)
            while not np.array_equal(further := last[last], last):
                last = further
            before = np.cumsum(counts) - counts
            piece = np.full(hi - lo, TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (key[lo:hi], piece, own, counts, own[last], before[last])], ["_key", "_piece", *_LONGS])

    return run


def _onward(left: DataFrame, times: DataFrame, cuts, window_ns: int) -> DataFrame:
    """(_key, _leave, _to): the first time after each window that a piece is left with. Windows without one have no row."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, leave = (c.to_numpy() for c in batch.columns)
            piece, to = np.full(len(key), AT_END, np.int64), np.zeros(len(key), np.int64)
            for k in np.unique(key).tolist():
                firsts, lasts, numbers = cuts.value[k]
                own = np.flatnonzero(key == k)
                ends = leave[own] + window_ns
                at = np.searchsorted(lasts, ends, "right")
                there = at < len(lasts)
                own, ends, at = own[there], ends[there], at[there]
                # where the window ends before the piece, the piece's first time is the answer
                piece[own] = np.where(ends < firsts[at], KNOWN, numbers[at])
                to[own] = firsts[at]
            kept = piece != AT_END
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[kept]), pa.array(leave[kept]), pa.array(piece[kept]), pa.array(to[kept], mask=piece[kept] != KNOWN)],
                ["_key", "_leave", "_piece", "_to"])

    placed = as_table(left.mapInArrow(place, "_key BIGINT, _leave BIGINT, _piece BIGINT, _to BIGINT"), "rate-left")
    asked = placed.where("_to IS NULL")
    none = F.lit(None).cast("bigint")
    both = asked.select("_key", "_piece", (F.col("_leave") + window_ns).alias("_at"), "_leave", none.alias("_t")).union(
        times.select("_key", "_piece", F.col("_t").alias("_at"), none, "_t"))
    # from the latest on; at equal times the question comes first, since it is for a later time
    later = Window.partitionBy("_key", "_piece").orderBy(F.desc("_at"), F.col("_t").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    found = both.withColumn("_to", F.last("_t", ignorenulls=True).over(later)).where("_leave IS NOT NULL")
    return placed.where("_to IS NOT NULL").select("_key", "_leave", "_to").union(found.select("_key", "_leave", "_to"))


def _reached(edges: DataFrame, first: DataFrame, steps: int) -> DataFrame:
    """(_key, _t): what is reached from ``first`` along ``edges`` (_key, _t, _to) in up to ``steps`` steps."""
    powers = [as_table(edges, "rate-jumps")]
    for _ in range((steps - 1).bit_length()):
        ahead = powers[-1].select("_key", F.col("_t").alias("_to"), F.col("_to").alias("_then"))
        powers.append(as_table(powers[-1].join(ahead, ["_key", "_to"]).select("_key", "_t", F.col("_then").alias("_to")), "rate-jumps"))
    reached = as_table(first.select("_key", "_t"), "rate-entries")
    for jump in reversed(powers):
        # one row per piece at most
        further = jump.join(F.broadcast(reached), ["_key", "_t"], "left_semi").select("_key", F.col("_to").alias("_t"))
        reached = as_table(reached.union(further).distinct(), "rate-entries")
    return reached


def _piece_of(cuts, ts: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(ts).null_count:
                raise ValueError(f"column {ts!r} has NULLs")
            key, times = batch.column("_key").to_numpy(), batch.column(ts).to_numpy()
            chunk = np.zeros(len(key), np.int64)
            for k in np.unique(key).tolist():
                own = key == k
                firsts, _, numbers = cuts.value[k]
                chunk[own] = numbers[np.searchsorted(firsts, times[own], "right") - 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(chunk)], [*kept, "_chunk"])

    return run
