"""Frames built from columns with native expressions, so that decoding can be checked against the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _be(value: Column | str, size: int) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.lpad(F.hex(col.cast("bigint")), 2 * size, "0")


def build_frames(df: DataFrame, *, keep: tuple[str, ...] = ("seq", "ts_ns")) -> DataFrame:
    """Ethernet frames from ``src_ip, dst_ip, src_port, dst_port, proto, n_vlan, payload`` plus the ``keep`` columns."""
    is_tcp = F.col("proto") == 6
    transport_bytes = F.when(is_tcp, 20).otherwise(8)
    data_bytes = F.octet_length("payload")
    tags = F.when(F.col("n_vlan") == 0, "").when(F.col("n_vlan") == 1, "81000001").otherwise("88A8000281000001")
    tcp = F.concat(_be("src_port", 2), _be("dst_port", 2), F.lit("000000010000000050180200" + "00000000"))
    udp = F.concat(_be("src_port", 2), _be("dst_port", 2), _be(data_bytes + 8, 2), F.lit("0000"))
    header = F.concat(
        F.lit("020000000002020000000001"), tags, F.lit("0800"),
        F.lit("4500"), _be(F.lit(20) + transport_bytes + data_bytes, 2), F.lit("0000400040"), _be("proto", 1),
        F.lit("0000"), _be("src_ip", 4), _be("dst_ip", 4), F.when(is_tcp, tcp).otherwise(udp),
    )
    return df.select(*keep, F.concat(F.unhex(header), F.col("payload").cast("binary")).alias("frame"))
