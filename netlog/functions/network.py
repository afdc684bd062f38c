"""IPv4 text and protocol names. An address is its big-endian u32 as BIGINT (10.0.0.1 = 167772161)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import PROTO_TCP, PROTO_UDP

_DOTTED = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def ip_value(text: Column) -> Column:
    """Dotted quad to BIGINT; NULL when the text is not one."""
    parts = F.split(text, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.element_at(parts, i + 1).cast("bigint")
    return F.when(text.rlike(_DOTTED), value)


def ip_text(value: Column) -> Column:
    octets = [F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def cidr_plen(cidr: Column) -> Column:
    """Prefix length of ``a.b.c.d/n``; a bare address is a /32; NULL when out of range."""
    plen = F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1)).otherwise(F.lit("32")).try_cast("int")
    return F.when(plen.between(0, 32), plen)


def cidr_net(cidr: Column) -> Column:
    """Network address of ``a.b.c.d/n`` with the host bits cleared."""
    host_bits = F.lit(32) - cidr_plen(cidr)
    size = F.pow(F.lit(2), host_bits).cast("bigint")
    address = ip_value(F.substring_index(cidr, "/", 1))
    return address - F.pmod(address, size)


def protocol_number(name: Column) -> Column:
    """``tcp`` and ``udp`` in any case; everything else NULL."""
    lowered = F.lower(name)
    return F.when(lowered == "tcp", PROTO_TCP).when(lowered == "udp", PROTO_UDP)
