"""Small helpers that the operators share: Arrow batches in, NumPy arrays of words inside, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# A word's bytes never hold these; on bytes, ``split()`` cuts at exactly the same six.
WORD = r"[^\x20\x09-\x0D]+"
# Entries of a per-process cache of words; beyond it the cache starts anew, so memory stays bounded.
CACHE_WORDS = 100_000
# Bytes of text that are worked on together.
BLOCK_BYTES = 4 << 20
# Rows of an Arrow batch.
BATCH_ROWS = 1_000


class WordHash(dict):
    """64-bit hash of a word's bytes. The same in every process; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHash()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def release() -> None:
    """Give back what a task's texts took; the worker process goes on to other stages."""
    HASHES.clear()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values, in order; shorter input gives none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i:i + n]
    return mix(out)


def as_bytes(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value, empty for null."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def in_blocks(batch: pa.RecordBatch, sizes: Sequence[int], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about ``most`` bytes; a longer row is a part of its own."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_blocks(
    df: DataFrame, columns: dict[str, Column], block: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType,
    size_of: str,
) -> DataFrame:
    """``block`` over ``columns`` of ``df``, in parts whose ``size_of`` column (binary) has a bounded length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_pylist()
            for part in in_blocks(batch, lengths):
                yield block(part)
        release()

    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, on the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_ROWS rows: whole texts are long rows, and workers keep what a batch took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def hash_below(column: Column, wanted: int, total: int) -> Column:
    """Whether a 64-bit hash is in the lowest part of its range that holds about ``wanted`` of ``total`` values.

    A sample that no task has to rank: each row decides alone, the same way each time, and about ``wanted`` rows say yes.
    """
    if total <= wanted:
        return F.lit(True)
    return column <= F.lit(-(1 << 63) + (wanted << 64) // total)
