import base64
import json
import struct

from pyspark.sql import functions as F

import netlog as nl
from netlog.operators.payloads import _latest_stored
from netlog.plans.pipeline import run_batch
from netlog.schemas import FRAMES, INTEREST, MESSAGES
from netlog.sources import log_lines, read_records

EVENTS = "seq BIGINT, ts_ns BIGINT, is_ref BOOLEAN, payload_ref BIGINT, data_len BIGINT, data BINARY"


def record(data_len, data=b"", is_ref=0, offset=0, conn=1, pid=2, tid=3, ts=2**63 - 1):
    return struct.pack("<III4xQB3sII1024s4x", conn, pid, tid, ts, is_ref, b"\0" * 3, offset, data_len, data)


def test_record_decode_and_validity(spark):
    items = [
        record(7, b'{"a":1}', conn=2**32 - 1), record(7, b'{"a":1}')[:1063], record(0), record(1024, b"x" * 1024),
        record(1025, b"x" * 1024), record(1_048_577), record(8, is_ref=1, offset=64), record(8, is_ref=1, offset=128),
        record(65_536, is_ref=1, offset=192), record(3, b"abc", is_ref=2), record(1, b"x", ts=2**63), b"",
    ]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(items)], "seq BIGINT, record BINARY")
    events = nl.decode_records(df)
    first = events.where("seq = 0").first()
    assert (first.conn_id, first.pid, first.tid, first.ts_ns) == (2**32 - 1, 2, 3, 2**63 - 1)
    assert (first.is_ref, first.payload_ref, first.data_len, bytes(first.data)) == (False, None, 7, b'{"a":1}')
    assert events.where("seq = 10").first().ts_ns is None
    payloads = spark.createDataFrame(
        [(64, 0, 0, bytearray(b"12345678")), (192, 0, 2, bytearray(b"z" * 65_536))],
        "payload_ref BIGINT, ts_ns BIGINT, seq BIGINT, payload BINARY",
    )
    for hot_rows in (None, 100_000, 0):
        got = {r.seq: r for r in nl.resolve_payloads(events, payloads, hot_rows=hot_rows, part_rows=2).collect()}
        assert [got[i].reject_reason for i in range(12)] == [
            None, "short_record", "empty", None, "bad_inline_len", "too_large", None, "bad_ref", None, None, None,
            "short_record",
        ]
        assert bytes(got[6].data) == b"12345678" and len(got[8].data) == 65_536 and len(got[3].data) == 1024
        assert bytes(got[9].data) == b"abc"
        assert all(got[i].data is None for i in (1, 2, 4, 5, 7))


def test_resolve_edges(spark):
    events = spark.createDataFrame([
        (0, 0, True, None, 5, None), (1, 0, True, 9, 5, None), (2, 0, True, 9, 99, None), (3, 0, None, None, 2, bytearray(b"abc")),
        (4, 0, True, 9, 5, bytearray(b"other")),
    ], EVENTS)
    payloads = spark.createDataFrame([(9, 0, 0, bytearray(b"hello world"))], "payload_ref BIGINT, ts_ns BIGINT, seq BIGINT, payload BINARY")
    got = {r.seq: (r.reject_reason, None if r.data is None else bytes(r.data)) for r in nl.resolve_payloads(events, payloads).collect()}
    assert got == {
        0: ("bad_ref", None), 1: (None, b"hello"), 2: ("short_payload", None), 3: (None, b"ab"), 4: (None, b"hello")
    }
    bounded = nl.resolve_payloads(events, payloads, max_ref=13)
    assert {r.seq for r in bounded.where("reject_reason = 'bad_ref'").collect()} == {0, 1, 2, 4}


def test_only_readable_pointers_are_shuffled(spark, tmp_path):
    rows = [(i, 0, i % 3 == 0, 9 if i % 2 else None, 5, bytearray(b"inline")) for i in range(60)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    payloads = spark.createDataFrame(
        [(9, 0, 0, bytearray(b"hello world"))], "payload_ref BIGINT, ts_ns BIGINT, seq BIGINT, payload BINARY"
    )
    resolved = nl.resolve_payloads(events, payloads, hot_rows=3, part_rows=2)
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    own, joined = plan.split("SortMergeJoin")[0], plan.split("SortMergeJoin")[1]
    assert "Exchange" not in own and "Exchange" in joined
    got = resolved.groupBy("is_ref", "reject_reason").count().collect()
    assert {(r.is_ref, r.reject_reason): r["count"] for r in got} == {
        (False, None): 40, (True, None): 10, (True, "bad_ref"): 10
    }


def test_only_wanted_payloads_are_moved(spark, tmp_path):
    """Without broadcasts of tables, bytes are shuffled only for the rows that events refer to, the latest of each."""
    stored = [(ref, ts, 0, bytearray(b"%d/%d" % (ref, ts))) for ref in range(300) for ts in range(5)]
    schema = "payload_ref BIGINT, ts_ns BIGINT, seq BIGINT, payload BINARY"
    spark.createDataFrame(stored, schema).write.parquet(str(tmp_path / "payloads"))
    payloads = spark.read.parquet(str(tmp_path / "payloads"))
    events = spark.createDataFrame([(i, 0, True, 7 * i, 3, None) for i in range(10)], EVENTS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = events.select(F.col("payload_ref").alias("_ref")).distinct()
        latest = _latest_stored(payloads, wanted)
        assert {(r._ref, bytes(r._stored)) for r in latest.collect()} == {(7 * i, b"%d/4" % (7 * i)) for i in range(10)}
        plan = latest._jdf.queryExecution().optimizedPlan().toString()
        # the only aggregate over bytes stands above the filter's join; below it, bytes are in no aggregate
        top, below = plan.split("LeftOuter", 1)
        assert "payload" in top and not any("payload#" in line for line in below.splitlines() if "Aggregate" in line)
        got = nl.resolve_payloads(events, payloads)
        assert {r.seq: bytes(r.data) for r in got.collect()} == {i: (b"%d/4" % (7 * i))[:3] for i in range(10)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_are_judged_without_stored_payloads(spark, tmp_path):
    items = [record(7, b'{"a":1}'), record(5_000, b"{" * 1024), record(2_000_000, b"x"), record(8, is_ref=1, offset=64), record(0)]
    records = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(items)], "seq BIGINT, record BINARY")
    none = spark.createDataFrame([], FRAMES)
    out = run_batch(spark, str(tmp_path), frames=none, interest=spark.createDataFrame([], INTEREST), records=records)
    found = out["logs"].collect()
    assert [r.value for r in found if r.channel == "logs"] == ['{"a":1}']
    assert {(r["seq"], r["reject_reason"]) for r in map(json.loads, (r.value for r in found if r.channel == "rejects"))} == {
        (1, "bad_inline_len"), (2, "too_large"), (3, "bad_ref"), (4, "empty")}


def test_message_clamp(spark):
    sizes = [0, 1, 65_536, 65_537]
    df = spark.createDataFrame([(i, 0, 80, 6, "c", bytearray(b"x" * n)) for i, n in enumerate(sizes)], MESSAGES)
    whole = nl.clamp_messages(df)
    assert {r.seq: (r["size"], len(r.payload)) for r in whole.collect()} == {i: (n, n) for i, n in enumerate(sizes) if n}
    clamped = nl.clamp_messages(df, slot_bytes=65_536)
    assert {r.seq: (r["size"], r.original_size, r.truncated) for r in clamped.collect()} == {
        1: (1, 1, False), 2: (65_536, 65_536, False), 3: (65_536, 65_537, True)}
    resolved = nl.resolve_payloads(
        nl.merge_sources(sk_msg=nl.message_events(clamped)).withColumn("data", F.lit(None).cast("binary")),
        nl.message_payloads(clamped),
    )
    assert {r.seq: len(r.data) for r in resolved.collect()} == {1: 1, 2: 65_536, 3: 65_536}


def test_read_capture_files(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    blobs = [b"".join(record(3, b"%03d" % i, tid=i) for i in range(n)) for n in (10, 1)]
    (folder / "a.bin").write_bytes(blobs[0])
    (folder / "b.bin").write_bytes(blobs[1] + b"tail")
    (folder / "empty.bin").write_bytes(b"")
    (folder / "_SUCCESS").write_bytes(b"x")
    events = nl.decode_records(read_records(spark, str(folder))).collect()
    assert sorted(e.tid for e in events if e.reject_reason is None) == [*sorted([0, *range(10)])]
    assert [(e.path.endswith("b.bin"), e.record_no) for e in events if e.reject_reason] == [(True, 1)]


def test_record_ranges_split_and_join(spark, tmp_path, monkeypatch):
    from netlog.sources import records as module

    path = tmp_path / "one.bin"
    path.write_bytes(b"".join(record(1, b"x", tid=i) for i in range(50)) + b"rest")
    monkeypatch.setattr(module, "RANGE_RECORDS", 7)
    monkeypatch.setattr(module, "BATCH_RECORDS", 3)
    reader = module.RecordReader(str(path))
    parts = reader.partitions()
    assert len(parts) == 8
    rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    assert [r["record_no"] for r in rows] == list(range(51))
    assert b"".join(r["record"] for r in rows) == path.read_bytes()


def test_retain_latest(spark):
    df = spark.createDataFrame([(i, i // 2, i % 3) for i in range(20)], "seq BIGINT, ts_ns BIGINT, k INT")
    assert sorted(r.seq for r in nl.retain_latest(df, 3).collect()) == [17, 18, 19]
    kept = nl.retain_latest(df, 2, by=["k"])
    assert sorted(r.seq for r in kept.collect()) == [14, 15, 16, 17, 18, 19]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_size_route(spark):
    df = spark.createDataFrame([(0,), (1,), (1024,), (1025,)], "n INT")
    assert [r[0] for r in df.select(nl.size_route(F.col("n"))).collect()] == [None, "inline", "inline", "large"]


def test_latest_payload_of_a_reference_counts(spark):
    events = spark.createDataFrame([(1, 10, True, 5, 3)], "seq long, ts_ns long, is_ref boolean, payload_ref long, data_len long")
    stored = spark.createDataFrame([(5, 1, 1, b"old"), (5, 2, 1, b"new")], "payload_ref long, ts_ns long, seq long, payload binary")
    got = nl.resolve_payloads(events.withColumn("data", F.lit(None).cast("binary")), stored).collect()
    assert [bytes(r.data) for r in got] == [b"new"]


def test_rejects_keep_their_bytes(spark):
    events = spark.createDataFrame(
        [(1, 1, False, None, 9, b"x" * 9), (2, 2, True, 7, 4, None)],
        "seq long, ts_ns long, is_ref boolean, payload_ref long, data_len long, data binary")
    stored = spark.createDataFrame([], "payload_ref long, payload binary")
    lines = log_lines(nl.parse_logs(nl.resolve_payloads(events, stored, inline_max=8))).orderBy("value").collect()
    one, two = (json.loads(r.value) for r in lines)
    assert (one["reject_reason"], base64.b64decode(one["data"])) == ("bad_inline_len", b"x" * 9)
    assert (two["reject_reason"], two["payload_ref"]) == ("bad_ref", 7)
