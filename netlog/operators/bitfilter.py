"""A filter of fixed size that tells one scan what another one is looking for, so that wide rows need not be shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# 16 MB. A fuller filter lets more rows through, no fewer.
FILTER_BITS = 27


def bit_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A filter of ``2 ** bits`` bits of the hashes ``key``, as rows (bucket, bits) of 4,096 bytes; ``bits`` is 15 or more.

    Its size is fixed, so it can be broadcast whatever ``keys`` has. Bits are gathered within tasks first.
    """
    place = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    return keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def with_filter(df: DataFrame, key: str, bit_rows: DataFrame, out: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``out``: whether the hash ``key`` is in the filter. Some that are not in it are said to be."""
    place = F.pmod(F.col(key), F.lit(1 << bits)) + 1
    placed = df.withColumns({"_b": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place)})
    met = placed.join(F.broadcast(bit_rows), F.col("_b") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_at div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, F.expr("cast(_at % 8 as int)")) == 1, F.lit(False))
    return met.withColumn(out, held).drop("_b", "_at", "_bucket", "_bits")
