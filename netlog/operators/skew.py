"""Hot keys: find them once, then cut their rows into time chunks that spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key below this many rows is one sorted run in one task.
HOT_ROWS = 5_000_000
# Rows wanted in one chunk of a hot key.
CHUNK_ROWS = 1_000_000
# A chunk with a burst is cut this many times finer than its average rate asks for, as the burst fills only part of it.
BURST_CUTS = 16


def hot_keys(
    df: DataFrame, keys: Sequence[str], ts: str, *, min_chunk_ns: int, hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The keys with more than ``hot_rows`` rows, as ``_hot_<key>``, and ``_width``, the time an average chunk takes.

    Reads only ``keys`` and ``ts``. Each key here stands for over ``hot_rows`` rows, so of 10**12 rows the list has at most
    200,000 with the default, and none is left out.
    """
    span = "_last - _first + 1"
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min(ts).alias("_first"), F.max(ts).alias("_last"))
        .where(F.col("_rows") > hot_rows)
        .select(
            *[F.col(k).alias(f"_hot_{k}") for k in keys],
            F.expr(f"greatest({min_chunk_ns}L, cast(ceil(({span}) / _rows * {chunk_rows}) as bigint))").alias("_width"),
        )
    )


def hot_chunks(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], ts: str, *, min_chunk_ns: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``_chunk``, the start of the row's time chunk: NULL for a key that is not in ``hot``.

    A hot key's time span is first cut evenly, by its average rate. A chunk that then holds over twice ``chunk_rows``
    rows, from a burst, is cut once more and finer. No chunk is cut below ``min_chunk_ns``. The cuts come from exact
    counts of ``keys`` and ``ts``, made per task before they are shuffled, so a repeated task cuts in the same places.
    Each of them stands for over two chunks of rows, which bounds their list too. They decide only how rows are spread: every key gives the same answer on either path.
    """
    coarse = df.join(F.broadcast(hot), same_key(keys, "_hot_"), "left").withColumn("_coarse", _cut(f"`{ts}`", "_width"))
    dense = (
        coarse.where("_width IS NOT NULL").groupBy(*keys, "_coarse", "_width").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_part", F.expr(
            f"greatest({min_chunk_ns}L, cast(ceil(_width / (ceil(_rows / {chunk_rows}) * {BURST_CUTS})) as bigint))"
        ))
        .where((F.col("_rows") > 2 * chunk_rows) & (F.col("_part") < F.col("_width")))
        .select(*[F.col(k).alias(f"_dense_{k}") for k in keys], F.col("_coarse").alias("_from"), "_part")
    )
    fine = coarse.join(F.broadcast(dense), same_key(keys, "_dense_") & F.expr("_coarse = _from"), "left")
    chunk = F.coalesce(F.col("_from") + _cut(f"(`{ts}` - _from)", "_part"), F.col("_coarse"))
    return fine.select(*df.columns, chunk.alias("_chunk"))


def same_key(keys: Sequence[str], prefix: str) -> Column:
    return F.expr(" AND ".join(f"`{k}` <=> `{prefix}{k}`" for k in keys))


def _cut(ts: str, width: str) -> Column:
    """Start of the interval of ``width`` that holds ``ts``, in integers throughout."""
    return F.expr(f"cast({ts} - pmod({ts}, {width}) as bigint)")
