"""Enter/exit call pairing per thread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bits import clamp
from .skew import CHUNK_ROWS, HOT_ROWS, hot_chunks, hot_keys, same_key

_BEFORE_ALL = -(2**63)


def pair_calls(
    events: DataFrame, keys: Sequence[str] = ("pid", "tid"), ts: str = "ts_ns", seq: str = "seq", *,
    max_bytes: int | None = None, hot_rows: int | None = HOT_ROWS, chunk_rows: int = CHUNK_ROWS,
    opened: DataFrame | None = None,
) -> DataFrame:
    """Pair each successful exit with the buffer its thread last entered with.

    An enter stores its buffer, replacing a stored one. An exit with ``ret > 0`` takes the stored buffer; without one
    it gives no pair. An exit with ``ret <= 0`` changes nothing. So what an exit sees is the last earlier row that
    stores or takes, which is a window function. Rows of a hot thread are cut into time chunks, and the last such row
    before each chunk leads it.

    ``opened`` goes on from earlier rows: (keys, buf, enter_ns) of the threads with a stored buffer, as ``open_calls`` gives.

    Returns ``keys, ts, seq, buf, enter_ns, data_len, data`` and, with ``max_bytes``, ``original_size`` and ``truncated``: data
    is whole unless ``max_bytes`` asks for a cut.
    """
    keys = list(keys)
    _, takes, state = _call_states(ts)
    needed = events.select(*keys, ts, seq, "kind", "ret", "data", state.alias("_state"))
    carried = None
    if opened is not None:
        held = F.struct(F.lit(True).alias("stored"), "buf", "enter_ns").cast(needed.schema["_state"].dataType)
        carried = opened.select(*keys, held.alias("_state"))

    if hot_rows is None:
        rows = needed.withColumns({"_chunk": F.lit(None).cast("bigint"), "_lead": F.lit(False)})
        if carried is not None:
            rows = rows.unionByName(carried.withColumn("_lead", F.lit(True)), allowMissingColumns=True)
    else:
        hot = hot_keys(needed, keys, ts, min_chunk_ns=1, hot_rows=hot_rows, chunk_rows=chunk_rows)
        chunked = hot_chunks(needed, hot, keys, ts, min_chunk_ns=1, chunk_rows=chunk_rows)
        last_state = (
            chunked.where(F.col("_chunk").isNotNull() & F.col("_state").isNotNull())
            .groupBy(*keys, "_chunk").agg(F.max_by("_state", F.struct(ts, seq)).alias("_state"))
        )
        whole = None
        if carried is not None:
            # before the first chunk of a hot thread, or before all rows of another
            known = carried.join(F.broadcast(hot), same_key(keys, "_hot_"), "left")
            first = F.when(F.col("_width").isNotNull(), _BEFORE_ALL).cast("bigint")
            placed = known.select(*keys, first.alias("_chunk"), "_state")
            last_state = last_state.unionByName(placed.where("_chunk IS NOT NULL"))
            whole = placed.where("_chunk IS NULL").withColumn("_lead", F.lit(True))
        leads = last_state.withColumn(
            "_state", F.lag("_state").over(Window.partitionBy(*keys).orderBy("_chunk"))
        ).withColumn("_lead", F.lit(True))
        rows = chunked.withColumn("_lead", F.lit(False)).unionByName(leads, allowMissingColumns=True)
        if whole is not None:
            rows = rows.unionByName(whole, allowMissingColumns=True)

    before = (
        Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_lead"), ts, seq)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = rows.withColumn("_seen", F.last("_state", ignorenulls=True).over(before))
    kept = F.col("ret") if max_bytes is None else clamp("ret", max_bytes)
    cut = [] if max_bytes is None else [
        F.col("ret").cast("bigint").alias("original_size"), (F.col("ret") > max_bytes).alias("truncated")]
    return seen.where(~F.col("_lead") & takes & F.col("_seen.stored")).select(
        *keys, ts, seq, F.col("_seen.buf").alias("buf"), F.col("_seen.enter_ns").alias("enter_ns"),
        kept.cast("bigint").alias("data_len"), F.substring("data", F.lit(1), kept.cast("int")).alias("data"), *cut,
    )


def open_calls(
    events: DataFrame, keys: Sequence[str] = ("pid", "tid"), ts: str = "ts_ns", seq: str = "seq", *,
    opened: DataFrame | None = None,
) -> DataFrame:
    """(keys, buf, enter_ns) of the threads with a stored buffer after ``events``, to go on from with ``pair_calls``.

    A thread's last state is found within each task before it is shuffled. ``opened`` is what was stored before.
    """
    _, _, state = _call_states(ts)
    order = F.struct(F.lit(1).alias("turn"), F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    states = events.select(*keys, state.alias("_state"), order.alias("_order")).where("_state IS NOT NULL")
    if opened is not None:
        types = {f.name: f.dataType for f in states.schema.fields}
        none = F.lit(None)
        earlier = F.struct(F.lit(0).alias("turn"), none.alias("ts"), none.alias("seq")).cast(types["_order"])
        held = F.struct(F.lit(True).alias("stored"), "buf", "enter_ns").cast(types["_state"])
        states = states.unionByName(opened.select(*keys, held.alias("_state"), earlier.alias("_order")))
    last = states.groupBy(*keys).agg(F.max_by("_state", "_order").alias("_state"))
    return last.where("_state.stored").select(*keys, "_state.buf", "_state.enter_ns")


def _call_states(ts: str) -> tuple[Column, Column, Column]:
    """Whether a row stores a buffer, whether it takes one, and what it leaves behind; NULL if it does neither."""
    stores = F.col("kind") == "enter"
    takes = (F.col("kind") == "exit") & (F.col("ret") > 0)
    return stores, takes, F.when(stores | takes, F.struct(stores.alias("stored"), F.col("buf"), F.col(ts).alias("enter_ns")))
