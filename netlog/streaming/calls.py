"""Call pairing on a stream: the stored buffer of each thread is its state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.calls import open_calls, pair_calls
from .carry import read_carry, write_carry


def pair_calls_batches(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("pid", "tid"), ts: str = "ts_ns", seq: str = "seq",
    *, trigger: dict | None = None, **pair_options,
) -> StreamingQuery:
    """Run ``pair_calls`` on each micro-batch, going on from the buffers that the one before left stored.

    For streams with hot threads: a micro-batch is shuffled, sorted and cut into chunks like a batch, so no thread's rows
    are held in memory. Pairs go to ``path/pairs/batch_id=N``; a repeated micro-batch replaces them. Threads with a stored
    buffer, one row each, are kept in ``path/open``. Rows of one micro-batch are taken in order of time, after all
    rows of those before.
    """
    keys = list(keys)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        held = T.StructType([*[batch.schema[k] for k in keys], batch.schema["buf"], T.StructField("enter_ns", batch.schema[ts].dataType)])
        opened = read_carry(batch.sparkSession, f"{path}/open", batch_id, held)
        pairs = pair_calls(batch, keys, ts, seq, opened=opened, **pair_options)
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch_id={batch_id}")
        write_carry(open_calls(batch, keys, ts, seq, opened=opened), f"{path}/open", batch_id)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def pair_calls_stream(
    events: DataFrame, keys: Sequence[str] = ("pid", "tid"), ts: str = "ts_ns", seq: str = "seq", *,
    max_bytes: int | None = None,
) -> DataFrame:
    """Same pairs and columns as ``pair_calls``; an enter and its exit may come in different micro-batches.

    The buffer address travels as text, since pandas would hold a column with NULLs as rounded floats. ``keys``, ``ts``
    and ``seq`` are non-NULL.
    """
    keys = list(keys)
    needed = events.select(
        *keys, ts, seq, "kind", F.col("buf").cast("string").alias("buf"), F.coalesce("ret", F.lit(0)).cast("bigint").alias("ret"),
        (F.col("data") if max_bytes is None else F.substring(F.col("data"), F.lit(1), F.lit(max_bytes))).alias("data"),
    )
    cut = [] if max_bytes is None else [
        T.StructField("original_size", T.LongType()), T.StructField("truncated", T.BooleanType())]
    out = T.StructType([
        *[needed.schema[name] for name in (*keys, ts, seq)], T.StructField("buf", T.StringType()),
        T.StructField("enter_ns", T.LongType()), T.StructField("data_len", T.LongType()),
        T.StructField("data", T.BinaryType()), *cut,
    ])
    names = out.fieldNames()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(batches), ignore_index=True).sort_values([ts, seq], kind="stable")
        stored = tuple(state.get) if state.exists else None
        pairs = []
        calls = zip(*[batch[name].tolist() for name in (ts, seq, "kind", "buf", "ret", "data")])
        for at, number, kind, buf, ret, data in calls:
            if kind == "enter":
                stored = (buf, at)
            elif kind == "exit" and ret > 0:
                if stored is not None:
                    size = ret if max_bytes is None else min(ret, max_bytes)
                    told = (ret, ret > size) if cut else ()
                    pairs.append((*key, at, number, *stored, size, None if data is None else bytes(data)[:size], *told))
                stored = None
        if stored is not None:
            state.update(stored)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(pairs, columns=names)

    pairs = needed.groupBy(*keys).applyInPandasWithState(
        step, out, "buf STRING, enter_ns BIGINT", "append", GroupStateTimeout.NoTimeout
    )
    return pairs.withColumn("buf", F.col("buf").cast("bigint"))
