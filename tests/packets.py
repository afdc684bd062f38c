"""Hand-made frames."""

import struct


def frame(
    *, tags=(), ethertype=0x0800, src=0x0A000001, dst=0x0A000002, proto=6, sport=40000, dport=8080, payload=b"",
    doff=5, ihl=5, tot_len=None, cut=None, pad=0,
):
    link = b"\x02" * 12
    for tag in tags:
        link += struct.pack(">HH", tag, 1)
    link += struct.pack(">H", ethertype)
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 1, 0, doff << 4, 0x18, 512, 0, 0) + b"\x01" * (doff * 4 - 20)
    elif proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    else:
        l4 = b"\x08\x00\x00\x00"
    options = b"\x01" * (ihl * 4 - 20)
    total = 20 + len(options) + len(l4) + len(payload) if tot_len is None else tot_len
    ip = struct.pack(">BBHHHBBHII", 0x40 | ihl, 0, total, 0, 0x4000, 64, proto, 0, src, dst)
    data = link + ip + options + l4 + payload + b"\x00" * pad
    return data if cut is None else data[:cut]


def frames(spark, items):
    rows = [(i, i, bytearray(data)) for i, data in enumerate(items)]
    return spark.createDataFrame(rows, "seq BIGINT, ts_ns BIGINT, frame BINARY")
