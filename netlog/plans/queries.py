"""Queries over the driver's tables. The network columns are derived from ``events`` and ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import operators as op
from ..functions import cidr_net, cidr_plen, ip_text, ip_value, monotonic_to_timestamp, split_pid_tid
from ..schemas import INTEREST, PAYLOADS, TUNING
from ..session import configure
from ..sources import log_lines
from ..sources.interest import accepted_loads, effective_interest, normalize_interest
from ..sources.tuning import decode_tuning, latest_tuning
from .frames import build_frames

DAY_NS = 86_400_000_000_000
RATE_WINDOW = 3 * DAY_NS
RATE_LIMIT = 1

# Port and protocol each event type stands for.
PORTS = {"click": (443, 6), "view": (8080, 6), "error": (514, 17), "signup": (53, 17), "purchase": (22, 6)}
INTEREST_ROWS = [(443, 6, None), (8080, 6, None), (514, 17, None)]
ALLOWED_CIDRS = ["10.0.0.0/26", "10.0.0.16/28", "10.0.0.128/25"]
# effective from 2024-01-10 and 2024-01-20
TUNING_ROWS = [(1_704_844_800_000_000_000, 2, 2, 1, 2), (1_705_708_800_000_000_000, 3, 1, 2, 3)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per event, as columns."""
    kind = F.col("event_type")
    port = proto = None
    for name, (port_no, proto_no) in PORTS.items():
        port = F.when(kind == name, port_no) if port is None else port.when(kind == name, port_no)
        proto = F.when(kind == name, proto_no) if proto is None else proto.when(kind == name, proto_no)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (_micros() * 1000).alias("ts_ns"),
        (F.col("user_id") + 167_772_160).alias("src_ip"), F.lit(167_837_697).cast("bigint").alias("dst_ip"),
        (F.pmod("event_id", F.lit(20_000)) + 40_000).cast("int").alias("src_port"), port.alias("dst_port"),
        proto.alias("proto"), F.pmod("event_id", F.lit(3)).cast("int").alias("n_vlan"),
        F.col("props").cast("binary").alias("payload"),
    )


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_frames(traffic(spark, sf_dir))


def interest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTEREST_ROWS, INTEREST)


def allowlist(spark: SparkSession) -> DataFrame:
    cidrs = spark.createDataFrame([(c,) for c in ALLOWED_CIDRS], "cidr STRING")
    return cidrs.select(cidr_plen(F.col("cidr")).alias("plen"), cidr_net(F.col("cidr")).alias("net"))


def tuning(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TUNING_ROWS, TUNING)


def captured_fields(spark, sf_dir):
    """Flagship: per port of interest, captured payloads, how many parse, and what their key ``k`` adds up to."""
    events = op.capture_inline(op.decode_frames(frames(spark, sf_dir)), interest(spark), keep=["dst_port"])
    return (
        op.parse_logs(events).withColumn("k", op.field("k", "bigint")).groupBy("dst_port")
        .agg(
            F.count(F.lit(1)).alias("captured"), F.count("doc").alias("parsed"), F.sum("k").alias("sum_k"),
            F.max("k").alias("max_k"),
        )
    )


def decode_flows(spark, sf_dir):
    return op.decode_frames(frames(spark, sf_dir)).select(
        "seq", "ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "n_vlan", "payload_len", "decode_status"
    )


def damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames, each cut short by an amount that depends on its number, so every decode exit occurs."""
    whole = frames(spark, sf_dir)
    cut = F.pmod("seq", F.lit(80)).cast("int")
    return whole.withColumn("frame", F.substring(F.col("frame"), F.lit(1), cut))


def decode_status(spark, sf_dir):
    return op.reason_counts(op.decode_frames(damaged_frames(spark, sf_dir)), "decode_status", by=["n_vlan"])


def capture_inline(spark, sf_dir):
    events = op.capture_inline(op.decode_frames(frames(spark, sf_dir)), interest(spark))
    return events.select(
        "seq", "ts_ns", "data_len", F.col("data").cast("string").alias("data"),
        F.col("reject_reason").isNull().alias("complete"),
    )


def capture_reasons(spark, sf_dir):
    verdicts = op.capture_verdict(op.decode_frames(frames(spark, sf_dir)), interest(spark))
    return op.reason_counts(verdicts, "capture_reason")


def allowlist_lpm(spark, sf_dir):
    flows = op.decode_frames(frames(spark, sf_dir)).select("seq", "src_ip")
    return op.flag_allowlist(flows, allowlist(spark))


def allowlist_members(spark, sf_dir):
    flows = op.decode_frames(frames(spark, sf_dir)).select("seq", "src_ip")
    return op.allowlist_join(flows, allowlist(spark)).select("seq", ip_text(F.col("src_ip")).alias("src"))


def _verdicts(spark, sf_dir):
    flows = op.decode_frames(frames(spark, sf_dir)).select(
        "seq", "ts_ns", "src_ip", "src_port", "dst_port", "proto", "decode_status"
    )
    return op.edge_verdict(flows, interest(spark), allowlist(spark), window_ns=RATE_WINDOW, threshold=RATE_LIMIT)


def edge_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("seq", "edge_reason", "rate_window_start", "rate_count", "rate_limited")


def reason_counts(spark, sf_dir):
    return op.reason_counts(_verdicts(spark, sf_dir), "edge_reason")


def drop_total(spark, sf_dir):
    return op.drop_total(_verdicts(spark, sf_dir))


def rate_check(spark, sf_dir):
    packets = traffic(spark, sf_dir).select("seq", "ts_ns", "src_ip", "dst_port")
    return op.rate_check(
        packets, ["src_ip", "dst_port"], "ts_ns", ["seq"], window_ns=RATE_WINDOW, threshold=RATE_LIMIT
    )


def rate_check_hot(spark, sf_dir):
    """Rate per destination port: five keys hold all rows, so every key takes the chunked path."""
    packets = traffic(spark, sf_dir).select("seq", "ts_ns", "dst_port")
    return op.rate_check(
        packets, ["dst_port"], "ts_ns", ["seq"], window_ns=3_600_000_000_000, threshold=2, hot_rows=50, chunk_rows=200,
        chunk_windows=4,
    )


def json_parse(spark, sf_dir):
    text = table(spark, sf_dir, "events").select("event_id", damaged_props().alias("data"))
    return op.parse_logs(text).select("event_id", F.col("doc").isNotNull().alias("accepted"), "reject_reason")


def damaged_props():
    """``props``, cut or extended in every seventeenth row in one of four ways."""
    n, props = F.col("event_id"), F.col("props")
    return (
        F.when(F.pmod(n, F.lit(68)) == 0, F.substring(props, F.lit(1), F.octet_length(props) - 1))
        .when(F.pmod(n, F.lit(68)) == 17, F.concat(props, F.lit("] x")))
        .when(F.pmod(n, F.lit(68)) == 34, F.concat(F.lit("["), props, F.lit("]")))
        .when(F.pmod(n, F.lit(68)) == 51, F.lit(""))
        .otherwise(props)
    )


def json_fields(spark, sf_dir):
    logs = op.parse_logs(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), "props")
    pairs = op.flatten(op.with_fields(logs, {"k": "bigint"}))
    return pairs.select("event_id", "key", F.to_json("value").cast("bigint").alias("value"), "k")


def json_documents(spark, sf_dir):
    """Whole texts wrapped as JSON, parsed, and the text read back."""
    docs = table(spark, sf_dir, "documents")
    wrapped = F.to_json(F.struct("doc_id", "text", F.struct("lang", "source").alias("meta")))
    logs = op.parse_logs(docs.select("doc_id", wrapped.alias("data")))
    return logs.select(
        "doc_id", F.md5(op.field("text")).alias("text_md5"),
        F.try_variant_get("doc", "$.meta.lang", "string").alias("lang"),
        F.col("reject_reason").isNull().alias("accepted"),
    )


def ndjson_lines(spark, sf_dir):
    logs = op.parse_logs(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return logs.select("event_id", op.to_line().alias("value"))


def json_candidates(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("props").alias("text"))
    docs = table(spark, sf_dir, "documents").select("text")
    return op.reason_counts(op.candidates(op.merge_sources(events=events, documents=docs), "text"), "source")


def stage_counts(spark, sf_dir):
    text = table(spark, sf_dir, "events").select("event_id", damaged_props().alias("data"))
    return op.stage_counts(op.parse_logs(text))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One socket message per document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), (F.col("doc_id") * 1000).alias("ts_ns"),
        (F.pmod("doc_id", F.lit(7)) + 8000).cast("int").alias("local_port"), F.lit(6).alias("proto"),
        F.concat(F.lit("c"), F.pmod("doc_id", F.lit(21)).cast("string")).alias("conn_key"),
        F.col("text").cast("binary").alias("payload"),
    )


def route_by_size(spark, sf_dir):
    clamped = op.clamp_messages(messages(spark, sf_dir))
    return clamped.groupBy(op.size_route(F.col("size")).alias("route")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("largest")
    )


def _document_events(spark, sf_dir):
    """Small documents as inline events, all others as pointer events with their payload table."""
    docs = messages(spark, sf_dir)
    small = docs.where(op.size_route(F.octet_length("payload")) == "inline").select(
        "seq", "ts_ns", F.lit(False).alias("is_ref"), F.octet_length("payload").cast("bigint").alias("data_len"),
        F.col("payload").alias("data"),
    )
    clamped = op.clamp_messages(docs.where(op.size_route(F.octet_length("payload")) == "large"))
    merged = op.merge_sources(tc=small, sk_msg=op.message_events(clamped))
    return merged, op.message_payloads(clamped)


def resolve_payloads(spark, sf_dir):
    events, payloads = _document_events(spark, sf_dir)
    resolved = op.resolve_payloads(events, payloads)
    return resolved.select(
        "seq", "source", F.octet_length("data").cast("bigint").alias("n_bytes"), F.md5("data").alias("digest"),
        F.col("reject_reason").isNull().alias("resolved"),
    )


def resolve_hot(spark, sf_dir):
    """Every event points to the document with its user's number: few payloads, many references, all spread.

    Events without such a document, and one in eleven that claims a byte too many, are rejected.
    """
    clamped = op.clamp_messages(messages(spark, sf_dir))
    sizes = clamped.select(F.col("seq").alias("user_id"), "size")
    claimed = F.coalesce("size", F.lit(1)) + F.when(F.pmod("event_id", F.lit(11)) == 0, 1).otherwise(0)
    events = table(spark, sf_dir, "events").join(sizes, "user_id", "left").select(
        F.col("event_id").alias("seq"), (_micros() * 1000).alias("ts_ns"), F.lit(True).alias("is_ref"),
        F.col("user_id").alias("payload_ref"), claimed.alias("data_len"), F.lit(None).cast("binary").alias("data"),
    )
    resolved = op.resolve_payloads(events, op.message_payloads(clamped), hot_rows=20, part_rows=8)
    return resolved.select("seq", F.md5("data").alias("digest"), "reject_reason")


def retain_latest(spark, sf_dir):
    kept = op.retain_latest(traffic(spark, sf_dir), 100)
    return kept.select("seq", "ts_ns", F.octet_length("payload").cast("bigint").alias("n_bytes"))


def retain_latest_by_source(spark, sf_dir):
    kept = op.retain_latest(traffic(spark, sf_dir).select("seq", "ts_ns", "src_ip"), 3, by=["src_ip"])
    return kept.select("src_ip", "seq", "ts_ns")


def probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click enters, a view exits, other kinds are passed over; the thread is the user."""
    packed = F.shiftleft(F.col("user_id") + 1000, 32).bitwiseOR(F.col("user_id"))
    pid, tid = split_pid_tid("_packed")
    return (
        table(spark, sf_dir, "events").withColumn("_packed", packed).select(
            F.col("event_id").alias("seq"), (_micros() * 1000).alias("ts_ns"), pid.alias("pid"), tid.alias("tid"),
            F.when(F.col("event_type") == "click", "enter").when(F.col("event_type") == "view", "exit")
            .otherwise(F.col("event_type")).alias("kind"),
            (F.col("event_id") * 16).alias("buf"),
            F.when(F.col("event_type") == "view", (F.floor(F.col("value") * 100) - 1000).cast("int")).alias("ret"),
            F.when(F.col("event_type") == "view", F.col("props").cast("binary")).alias("data"),
        )
    )


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "pid", "tid", "ts_ns", "seq", "buf", "enter_ns", "data_len", F.col("data").cast("string").alias("data")
    )


def pair_calls(spark, sf_dir):
    return _pairs(op.pair_calls(probe_events(spark, sf_dir)))


def pair_calls_hot(spark, sf_dir):
    """All calls on one thread, which is cut into chunks."""
    calls = probe_events(spark, sf_dir).withColumns({"pid": F.lit(1).cast("bigint"), "tid": F.lit(1).cast("bigint")})
    return _pairs(op.pair_calls(calls, hot_rows=100, chunk_rows=50))


def conn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (_micros() * 1000).alias("ts_ns"),
        F.when(kind == "click", "active_established").when(kind == "view", "passive_established")
        .otherwise("state_change").alias("op"),
        (F.col("user_id") + 8000).cast("int").alias("local_port"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("conn_key"),
    )


def first_seen(spark, sf_dir):
    return op.first_seen(conn_events(spark, sf_dir)).select("local_port", "proto", "conn_key", "ts_ns", "seq")


def registered_messages(spark, sf_dir):
    registry = op.first_seen(conn_events(spark, sf_dir))
    # half of the messages come from ports that nobody registered
    port = F.when(F.col("local_port") % 2 == 0, F.col("local_port")).otherwise(F.col("local_port") - 8000)
    kept = op.registered_messages(messages(spark, sf_dir).withColumn("local_port", port), registry)
    return kept.groupBy("local_port").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("payload")).alias("bytes")
    )


def interest_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load per user, of entries derived from events; some name no known protocol, some loads a bad port."""
    kind = F.col("event_type")
    protocol = (
        F.when(kind == "click", "TCP").when(kind == "view", "tcp").when(kind == "error", "Udp")
        .when(kind == "signup", "sctp").otherwise("udp")
    )
    port = F.when((kind == "signup") & (F.col("value") > 150), 70_000).otherwise(F.floor(F.col("value") * 100))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("load_id"), F.col("ts").cast("timestamp").alias("loaded_at"),
        port.cast("bigint").alias("port"), protocol.alias("protocol"),
    )


def interest_normalize(spark, sf_dir):
    return normalize_interest(interest_loads(spark, sf_dir)).groupBy("proto", "reject_reason").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("port").alias("port_sum")
    )


def interest_effective(spark, sf_dir):
    effective = effective_interest(accepted_loads(normalize_interest(interest_loads(spark, sf_dir))))
    return effective.select("port", "proto", F.unix_micros("loaded_at").alias("loaded_us"))


def tuning_in_force(spark, sf_dir):
    packets = traffic(spark, sf_dir).select("seq", "ts_ns")
    return op.tuning_in_force(packets, tuning(spark))


def sampled(spark, sf_dir):
    packets = traffic(spark, sf_dir).select("seq", "ts_ns")
    return op.sample(op.tuning_in_force(packets, tuning(spark))).groupBy("version").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("seq").alias("seq_sum")
    )


def rate_check_tuned(spark, sf_dir):
    """The threshold of each packet is the one in force at its time."""
    packets = op.tuning_in_force(traffic(spark, sf_dir).select("seq", "ts_ns", "src_ip", "dst_port"), tuning(spark))
    checked = op.rate_check(
        packets, ["src_ip", "dst_port"], "ts_ns", ["seq"], window_ns=RATE_WINDOW, threshold=F.col("max_rate_pps")
    )
    return checked.select("seq", "window_start", "n", "max_rate_pps", "limited")


def _le(value, size):
    pairs = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(pairs, 2 * i + 1, 2) for i in reversed(range(size))])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events packed as 1,064-byte capture records; every fifth is a pointer, every thirteenth is cut short."""
    is_ref = F.pmod("event_id", F.lit(5)) == 0
    body = F.col("props").cast("binary")
    header = F.concat(
        _le(F.col("user_id"), 4), _le(F.col("user_id") + 1000, 4), _le(F.col("event_id"), 4), F.lit("00000000"),
        _le(_micros() * 1000, 8), F.when(is_ref, "01").otherwise("00"), F.lit("000000"),
        _le(F.col("event_id") * 64, 4), _le(F.octet_length(body), 4),
    )
    data = F.when(is_ref, F.lit(b"")).otherwise(body)
    padding = F.substring(F.lit(b"\0" * 1028), F.lit(1), F.lit(1028) - F.octet_length(data))
    record = F.concat(F.unhex(header), data, padding)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.pmod("event_id", F.lit(13)) == 0, F.substring(record, 1, 1063)).otherwise(record).alias("record"),
    )


def record_decode(spark, sf_dir):
    decoded = op.decode_records(records(spark, sf_dir)).drop("raw")
    return decoded.withColumn("data", F.col("data").cast("string"))


def tuning_records(spark, sf_dir):
    """Tuning structs packed from events, decoded, and the last one per source."""
    packed = F.unhex(F.concat(
        _le(F.col("event_id"), 4), _le(F.col("user_id"), 4), F.lit("00000000"), F.lit("01000000"), F.lit("0A000000")
    ))
    raw = table(spark, sf_dir, "events").select(
        (_micros() * 1000).alias("effective_ns"), F.col("event_id").alias("seq"), "event_type", packed.alias("record")
    )
    return latest_tuning(decode_tuning(raw), by=["event_type"])


def clamp_documents(spark, sf_dir):
    """Messages cut to a small slot, which says so."""
    cut = op.clamp_messages(messages(spark, sf_dir), slot_bytes=1000)
    return cut.select("seq", "size", "original_size", "truncated", F.md5("payload").alias("digest"))


def rejects_roundtrip(spark, sf_dir):
    """Damaged payloads through the sink's lines and back: the quarantine has the bytes that came in."""
    text = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), damaged_props().alias("data"))
    lines = log_lines(op.parse_logs(text)).where("channel = 'rejects'")
    back = F.from_json("value", "seq long, reject_reason string, data string")
    return lines.select(back.alias("r")).select(
        "r.seq", "r.reject_reason", F.unbase64(F.coalesce("r.data", F.lit(""))).cast("string").alias("data"))


def resolve_repeated_refs(spark, sf_dir):
    """Each payload is stored twice, the second time reversed and later: events get the later one, once."""
    docs = messages(spark, sf_dir).withColumn("size", F.octet_length("payload").cast("bigint")).where("size > 0")
    stored = op.message_payloads(docs)
    again = stored.withColumns({
        "ts_ns": F.col("ts_ns") + 1, "payload": F.reverse(F.col("payload").cast("string")).cast("binary")})
    events = op.message_events(docs).withColumn("data", F.lit(None).cast("binary"))
    resolved = op.resolve_payloads(events, stored.union(again))
    return resolved.select("seq", F.md5("data").alias("digest"), "reject_reason")


def tuning_short_records(spark, sf_dir):
    """Every third tuning record is cut short and changes nothing."""
    packed = F.unhex(F.concat(
        _le(F.col("event_id"), 4), _le(F.col("user_id"), 4), F.lit("00000000"), F.lit("01000000"), F.lit("0A000000")))
    cut = F.when(F.pmod("event_id", F.lit(3)) == 0, F.substring(packed, 1, 10)).otherwise(packed)
    raw = table(spark, sf_dir, "events").select(
        (_micros() * 1000).alias("effective_ns"), F.col("event_id").alias("seq"), cut.alias("record"))
    packets = traffic(spark, sf_dir).select("seq", "ts_ns")
    in_force = op.tuning_in_force(packets, decode_tuning(raw), order=("effective_ns", "seq"))
    return in_force.select("seq", "version", "max_rate_pps")


def event_times(spark, sf_dir):
    """Monotonic clock readings against a known boot time, back to wall-clock time."""
    boot_ns = 1_704_067_200_000_000_000
    clock = traffic(spark, sf_dir).select("seq", (F.col("ts_ns") - boot_ns).alias("ts_ns"))
    return clock.select("seq", F.unix_micros(monotonic_to_timestamp("ts_ns", boot_ns)).alias("ts_us"))


def address_text(spark, sf_dir):
    """Source addresses to dotted text and back, with the packets seen from each."""
    counted = traffic(spark, sf_dir).groupBy("src_ip").agg(F.count(F.lit(1)).alias("rows"))
    text = counted.withColumn("src", ip_text(F.col("src_ip")))
    return text.select("src", ip_value(F.col("src")).alias("src_ip"), "rows")


def records_without_payloads(spark, sf_dir):
    """Capture records with nothing stored: some claim more inline bytes than a record holds, some more than is ever read."""
    claimed = (
        F.when(F.pmod("event_id", F.lit(7)) == 0, 5_000).when(F.pmod("event_id", F.lit(11)) == 0, 2_000_000)
        .when(F.pmod("event_id", F.lit(17)) == 0, 0)
    )
    numbered = records(spark, sf_dir).withColumn("event_id", F.col("seq"))
    # the length is at bytes 32 to 35
    told = F.unhex(_le(F.coalesce(claimed, F.lit(0)), 4))
    changed = numbered.withColumn("record", F.when(
        claimed.isNotNull(), F.concat(F.substring("record", 1, 32), told, F.substring("record", 37, 1064))
    ).otherwise(F.col("record"))).drop("event_id")
    resolved = op.resolve_payloads(op.decode_records(changed), spark.createDataFrame([], PAYLOADS))
    return resolved.select("seq", "reject_reason", F.col("data").cast("string").alias("data"))


def unusual_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from the loopback and from port 22, to port 0, of other protocols, without payload, and cut short."""
    n = F.col("seq")

    def every(k: int, then, name: str):
        return F.when(F.pmod(n, F.lit(k)) == 0, then).otherwise(F.col(name)).alias(name)

    columns = traffic(spark, sf_dir).select(
        "seq", "ts_ns", every(17, F.lit(2_130_706_433), "src_ip"), "dst_ip", every(19, F.lit(22), "src_port"),
        every(23, F.lit(0), "dst_port"), every(29, F.lit(1), "proto"), "n_vlan", every(31, F.lit(b""), "payload"),
    )
    built = build_frames(columns, keep=("seq", "ts_ns", "n_vlan"))
    place = F.lit(13) + F.col("n_vlan") * 4
    other = F.when(F.pmod(n, F.lit(37)) == 0, F.overlay("frame", F.unhex(F.lit("86DD")), place)).otherwise(F.col("frame"))
    cut = F.when(F.pmod(n, F.lit(7)) == 0, F.substring(other, F.lit(1), F.pmod(F.floor(n / 7), F.lit(60)).cast("int")))
    return built.select("seq", "ts_ns", F.coalesce(cut, other).alias("frame"))


def edge_reasons(spark, sf_dir):
    """The verdict of every frame, where every reason occurs."""
    flows = op.decode_frames(unusual_traffic(spark, sf_dir)).select(
        "seq", "ts_ns", "src_ip", "src_port", "dst_port", "proto", "decode_status")
    verdicts = op.edge_verdict(flows, interest(spark), allowlist(spark), window_ns=RATE_WINDOW, threshold=RATE_LIMIT)
    return verdicts.select("seq", "edge_reason", "rate_window_start", "rate_count")


def capture_reasons_unusual(spark, sf_dir):
    verdicts = op.capture_verdict(op.decode_frames(unusual_traffic(spark, sf_dir)), interest(spark))
    return verdicts.select("seq", "capture_reason")


def pair_calls_cut(spark, sf_dir):
    """Paired calls of which five bytes are kept."""
    pairs = op.pair_calls(probe_events(spark, sf_dir), max_bytes=5)
    return _pairs(pairs).join(pairs.select("seq", "original_size", "truncated"), "seq")


def json_numbers(spark, sf_dir):
    """Numbers up to and beyond the range of a double, and the same as text."""
    power = F.pmod("event_id", F.lit(620))
    made = F.concat(F.lit('{"s":"1e999 \\\\\\"","k":['), F.col("user_id"), F.lit("e0,-1E+"), power, F.lit("]}"))
    logs = op.parse_logs(table(spark, sf_dir, "events").select("event_id", made.alias("data")))
    return logs.select("event_id", F.try_variant_get("doc", "$.k[0]", "bigint").alias("k"), op.field("s").alias("s"), "reject_reason")


def allowlist_intervals(spark, sf_dir):
    """A prefix per supplier, of any length and some invalid, as disjoint intervals in which addresses are looked up."""
    prefixes = table(spark, sf_dir, "supplier").select(
        (F.pmod("s_suppkey", F.lit(20)) + 14).cast("int").alias("plen"),
        (F.lit(167_772_160) + F.pmod(F.col("s_suppkey") * 37, F.lit(5_000))).alias("net"))
    flows = traffic(spark, sf_dir).select("seq", "src_ip")
    return op.flag_allowlist(flows, prefixes, max_keys=0)


def tuning_long_log(spark, sf_dir):
    """A tuning record with each event of one kind: a log that is merged with the packets by time."""
    changes = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        (_micros() * 1000).alias("effective_ns"), F.col("event_id").alias("version"), F.col("user_id").alias("max_rate_pps"),
        F.lit(1).cast("bigint").alias("sampling_num"), (F.pmod("event_id", F.lit(9)) + 1).alias("sampling_den"))
    packets = traffic(spark, sf_dir).select("seq", "ts_ns")
    return op.tuning_in_force(packets, changes, max_records=10, chunk_rows=500)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        captured_fields, decode_flows, decode_status, capture_inline, capture_reasons, allowlist_lpm,
        allowlist_members, edge_verdict, reason_counts, drop_total, rate_check, rate_check_hot, json_parse,
        json_fields, json_documents, ndjson_lines, json_candidates, stage_counts, route_by_size, resolve_payloads,
        resolve_hot, retain_latest, retain_latest_by_source, pair_calls, pair_calls_hot, first_seen,
        registered_messages, interest_normalize, interest_effective, tuning_in_force, sampled, rate_check_tuned,
        record_decode, tuning_records, event_times, address_text, clamp_documents, rejects_roundtrip,
        resolve_repeated_refs, tuning_short_records, records_without_payloads, edge_reasons, capture_reasons_unusual,
        pair_calls_cut, tuning_long_log, json_numbers, allowlist_intervals,
    )
}
