"""Header decode: Ethernet, up to two VLAN tags, IPv4, TCP or UDP."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.barrier import compute_once
from ..functions.bits import be_sql
from ..schemas import ETHERTYPE_IPV4, ETHERTYPE_QINQ, ETHERTYPE_VLAN, PROTO_TCP, PROTO_UDP

FLOW_COLUMNS = (
    "src_ip", "dst_ip", "src_port", "dst_port", "proto", "n_vlan", "payload_off", "payload_len", "decode_status",
)


def decode_frames(frames: DataFrame, *, frame: str = "frame", honor_ihl: bool = False) -> DataFrame:
    """Add the flow columns to ``frames``. Narrow and native: no shuffle, no Python.

    ``decode_status`` is the first reason decoding stopped: ``short_eth``, ``short_vlan``, ``not_ipv4``, ``short_ip``,
    ``short_l4``, ``not_tcp_udp`` or ``ok``. Columns past that point are NULL. The L4 header is read 20 bytes after
    the IPv4 header; ``honor_ihl=True`` uses the header length field instead. ``payload_len`` comes from the IPv4
    total length, so link padding is excluded; it may be zero or negative. ``n_vlan`` counts the tags seen.

    Each read of bytes goes through text, so a header is read in 8-byte words and split by shifts: a common frame
    costs five reads. Frames too short for the first word take single reads instead.
    """
    tags = f"({ETHERTYPE_VLAN}, {ETHERTYPE_QINQ})"
    ihl_bytes = f"greatest(20, ({be_sql(frame, '_ip', 1)} & 15) * 4)" if honor_ihl else "20"

    def columns(df: DataFrame, **expressions: str) -> DataFrame:
        return df.withColumns({name: F.expr(text) for name, text in expressions.items()})

    sized = columns(
        frames, _size=f"octet_length({frame})",
        _word=f"case when octet_length({frame}) >= 20 then {be_sql(frame, 12, 8)} end",
    )
    link = columns(
        sized,
        _type0=f"case when _size >= 20 then shiftrightunsigned(_word, 48) else {be_sql(frame, 12, 2)} end",
        _type1=f"case when _size >= 20 then shiftright(_word, 16) & 65535 when _size >= 18 then {be_sql(frame, 16, 2)} end",
    )
    seen = columns(
        link,
        _tags=f"case when _size < 14 or _type0 not in {tags} then 0 when _type1 in {tags} then 2 else 1 end",
    )
    located = columns(
        seen,
        _ip="14 + _tags * 4",
        _link=f"""case when _size < 14 then 'short_eth'
            when _size < 14 + _tags * 4 then 'short_vlan'
            when (case _tags when 0 then _type0 when 1 then _type1 else {be_sql(frame, 20, 2)} end) <> {ETHERTYPE_IPV4}
                then 'not_ipv4'
            when _size < 34 + _tags * 4 then 'short_ip' end""",
    )
    network = columns(
        located,
        _head=f"case when _link is null then {be_sql(frame, '_ip + 2', 8)} end",
        _ends=f"case when _link is null then {be_sql(frame, '_ip + 12', 8)} end",
        _l4=f"case when _link is null then _ip + cast({ihl_bytes} as int) end",
    )
    proto = columns(network, _proto="cast(_head & 255 as int)", _total="cast(shiftrightunsigned(_head, 48) as int)")
    judged = columns(
        proto,
        _status=f"""case when _link is not null then _link
            when _proto = {PROTO_TCP} then if(_size < _l4 + 20, 'short_l4', 'ok')
            when _proto = {PROTO_UDP} then if(_size < _l4 + 8, 'short_l4', 'ok')
            else 'not_tcp_udp' end""",
    )
    transport = columns(
        judged,
        _ports=f"case when _status = 'ok' then {be_sql(frame, '_l4', 4)} end",
        _body=f"""case when _status <> 'ok' then null
            when _proto = {PROTO_TCP}
                then _l4 + cast(shiftright({be_sql(frame, '_l4 + 12', 1)}, 4) * 4 as int)
            else _l4 + 8 end""",
    )
    made = {
        "src_ip": "shiftrightunsigned(_ends, 32)",
        "dst_ip": "_ends & 4294967295",
        "src_port": "cast(shiftright(_ports, 16) as int)",
        "dst_port": "cast(_ports & 65535 as int)",
        "proto": "_proto",
        "n_vlan": "case when _size >= 14 then _tags end",
        "payload_off": "_body",
        "payload_len": "_total - (_body - _ip)",
        "decode_status": "_status",
    }
    once = compute_once(transport, {name: F.expr(text) for name, text in made.items()})
    return once.select(*frames.columns, *FLOW_COLUMNS)
