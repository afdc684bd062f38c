"""Column schemas of the input and output tables.

Unsigned fields are widened: u8/u16 to INT, u32 to BIGINT. ``ts_ns`` is a monotonic nanosecond clock and stays
BIGINT because Spark timestamps hold microseconds.
"""

FRAMES = "seq BIGINT, ts_ns BIGINT, frame BINARY"

MESSAGES = "seq BIGINT, ts_ns BIGINT, local_port INT, proto INT, conn_key STRING, payload BINARY"

CAPTURE_EVENTS = (
    "seq BIGINT, source STRING, conn_id BIGINT, pid BIGINT, tid BIGINT, ts_ns BIGINT, "
    "is_ref BOOLEAN, payload_ref BIGINT, data_len BIGINT, data BINARY"
)

PAYLOADS = "payload_ref BIGINT, ts_ns BIGINT, seq BIGINT, payload BINARY"

INTEREST = "port INT, proto INT, loaded_at TIMESTAMP"

INTEREST_LOADS = (
    "load_id STRING, loaded_at TIMESTAMP, port BIGINT, protocol STRING, proto INT, reject_reason STRING"
)

ALLOWLIST = "plen INT, net BIGINT"

PROBE_EVENTS = "seq BIGINT, ts_ns BIGINT, pid BIGINT, tid BIGINT, kind STRING, buf BIGINT, ret INT, data BINARY"

CONN_EVENTS = "seq BIGINT, ts_ns BIGINT, op STRING, local_port INT, conn_key STRING"

TUNING = "effective_ns BIGINT, version BIGINT, max_rate_pps BIGINT, sampling_num BIGINT, sampling_den BIGINT"

# Protocol and size constants of the capture format.
PROTO_TCP = 6
PROTO_UDP = 17
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLAN = 0x8100
ETHERTYPE_QINQ = 0x88A8
LOOPBACK_IP = 0x7F000001
SSH_PORT = 22
INLINE_MAX = 1024
SLOT_BYTES = 65_536
MAX_JSON_BYTES = 1_048_576
RATE_WINDOW_NS = 1_000_000_000
RATE_THRESHOLD = 1000
RECORD_BYTES = 1064
TUNING_DEFAULTS = {"version": 1, "max_rate_pps": 1000, "sampling_num": 1, "sampling_den": 1}
