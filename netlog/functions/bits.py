"""Integer reads from binary columns. All native expressions; positions are 0-based byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def be_sql(data: str, offset: str | int, size: int) -> str:
    """SQL text of a big-endian read of up to 8 bytes; an 8-byte read keeps its 64 bits as a signed BIGINT."""
    return f"cast(conv(hex(substring({data}, {offset} + 1, {size})), 16, -10) as bigint)"


def u_be(data: str, offset: str | int, size: int) -> Column:
    """Big-endian unsigned integer of up to 7 bytes; NULL when the bytes lie past the end."""
    return F.expr(be_sql(data, offset, size))


def u_le(data: str, offset: int, size: int) -> Column:
    """Little-endian unsigned integer. A 64-bit value above the signed range gives NULL."""
    pairs = f"hex(substring({data}, {offset + 1}, {size}))"
    swapped = ", ".join(f"substring({pairs}, {2 * i + 1}, 2)" for i in reversed(range(size)))
    return F.expr(f"try_cast(conv(concat({swapped}), 16, 10) as bigint)")


def le_words(df: DataFrame, data: str, offsets: dict[str, int]) -> DataFrame:
    """Add 8-byte little-endian words as signed BIGINTs, one read each; narrower fields are shifts of them.

    The bytes are read in big-endian order and then swapped: neighbours, pairs, halves.
    """
    even_bytes, even_pairs = 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF
    steps = (
        f"(shiftrightunsigned({{w}}, 8) & {even_bytes}) | shiftleft({{w}} & {even_bytes}, 8)",
        f"(shiftrightunsigned({{w}}, 16) & {even_pairs}) | shiftleft({{w}} & {even_pairs}, 16)",
        "shiftrightunsigned({w}, 32) | shiftleft({w}, 32)",
    )
    read = df.withColumns({name: F.expr(be_sql(data, at, 8)) for name, at in offsets.items()})
    for step in steps:
        read = read.withColumns({name: F.expr(step.format(w=name)) for name in offsets})
    return read


def clamp(value: Column | str, upper: int) -> Column:
    return F.least(value if isinstance(value, Column) else F.col(value), F.lit(upper))


def split_pid_tid(value: Column | str) -> tuple[Column, Column]:
    """Process id (high word) and thread id (low word) of a packed 64-bit id."""
    col = F.col(value) if isinstance(value, str) else value
    return F.shiftrightunsigned(col, 32), col.bitwiseAND(F.lit(0xFFFFFFFF))


def monotonic_to_timestamp(ts_ns: Column | str, boot_ns: Column | int = 0) -> Column:
    """Wall-clock timestamp of a monotonic nanosecond reading, given the boot time in epoch nanoseconds."""
    col = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    boot = boot_ns if isinstance(boot_ns, Column) else F.lit(boot_ns)
    return F.timestamp_micros(F.call_function("div", col + boot, F.lit(1000)))
