import os
import json
import random

import pytest
from packets import frame
from pyspark.sql import functions as F
from test_payloads import record

import netlog as nl
from netlog.plans.pipeline import run_batch
from netlog.schemas import ALLOWLIST, CAPTURE_EVENTS, CONN_EVENTS, FRAMES, INTEREST, MESSAGES, PAYLOADS, PROBE_EVENTS
from netlog.sources import log_lines, read_records_stream, read_table_stream, records
from netlog.streaming import (
    flush_event_logs, pair_calls_batches, pair_calls_stream, rate_batches, rate_stream, retain_batches, retained,
    run_stream, stream_counts, stream_event_logs, stream_logs,
)
from netlog.streaming import rate
from netlog.streaming.carry import read_carry, write_carry

RATE = "k BIGINT, ts_ns BIGINT, seq BIGINT, note BIGINT"


def write_parts(spark, rows, schema, folder, n):
    """``n`` files in the order of the rows."""
    size = -(-len(rows) // n)
    for i in range(n):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))


def run_to_end(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def collect_stream(spark, df, tmp_path, mode="append"):
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "ckpt"))
        .option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    )
    run_to_end(query)
    return spark.read.parquet(str(tmp_path / "out"))


def rate_rows(seed=5, n=400):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 4, 30])
        rows.append((rng.randint(0, 3), t * 1_000_000, i, None if i % 3 else 2**60 + i))
    return rows


@pytest.mark.parametrize("lateness", [None, "0 seconds"])
def test_rate_stream_equals_batch(spark, tmp_path, lateness):
    rows = rate_rows()
    write_parts(spark, rows, RATE, tmp_path / "in", 4)
    stream = read_table_stream(spark, str(tmp_path / "in"), RATE, max_files=1)
    options = {"window_ns": 25_000_000, "threshold": 2}
    got = collect_stream(spark, rate_stream(stream, ["k"], "ts_ns", ["seq"], lateness=lateness, **options), tmp_path)
    want = nl.rate_check(spark.createDataFrame(rows, RATE), ["k"], "ts_ns", ["seq"], **options)
    columns = ["seq", "note", "window_start", "n", "limited"]
    assert sorted(map(tuple, got.select(columns).collect()), key=lambda r: r[0]) == sorted(
        map(tuple, want.select(columns).collect()), key=lambda r: r[0]
    )
    assert got.where("late").count() == 0


@pytest.mark.parametrize("options", [{}, {"hot_rows": 10, "chunk_rows": 20, "chunk_windows": 2}])
def test_rate_batches_equals_batch(spark, tmp_path, options):
    rows = rate_rows(7, 600)
    write_parts(spark, rows, RATE, tmp_path / "in", 4)
    stream = read_table_stream(spark, str(tmp_path / "in"), RATE, max_files=1)
    rates = {"window_ns": 25_000_000, "threshold": 2}
    run_to_end(rate_batches(
        stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["k"], "ts_ns", ["seq"], trigger={"availableNow": True},
        **rates, **options,
    ))
    columns = ["seq", "note", "window_start", "n", "limited"]
    got = spark.read.parquet(str(tmp_path / "out/rows")).select(columns).collect()
    want = nl.rate_check(spark.createDataFrame(rows, RATE), ["k"], "ts_ns", ["seq"], **rates)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(map(tuple, want.select(columns).collect()), key=lambda r: r[0])
    kept = spark.read.parquet(str(tmp_path / "out/open"))
    assert {r["count"] for r in kept.groupBy("batch_id").count().collect()} <= {1, 2, 3, 4}


def test_rate_batches_write_only_keys_that_came_and_drop_what_is_old(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rate, "SNAPSHOT_EVERY", 3)
    rows = [(k, 10 * b + j, 100 * b + 10 * j + k, None) for b in range(8) for j in range(3) for k in ({0, b} if b else range(6))]
    for b in range(8):
        part = spark.createDataFrame([r for r in rows if r[2] // 100 == b], RATE).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_table_stream(spark, str(tmp_path / "in"), RATE, max_files=1)
    rates = {"window_ns": 25, "threshold": 2}
    run_to_end(rate_batches(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["k"], "ts_ns", ["seq"],
                            trigger={"availableNow": True}, **rates))
    got = {r.seq: (r.window_start, r.n) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    want = nl.rate_check(spark.createDataFrame(rows, RATE), ["k"], "ts_ns", ["seq"], **rates)
    assert got == {r.seq: (r.window_start, r.n) for r in want.collect()}
    kept = {r.batch_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out/open")).groupBy("batch_id").count().collect()}
    # of each: key 0 and one more, or all keys; what came before the snapshot before the last is gone
    assert kept == {3: 6, 4: 2, 5: 2, 6: 7, 7: 2}


def test_one_wrong_clock_reading_closes_no_window(spark, tmp_path):
    batches = [[(0, 0, 1), (1, 1, 1), (2, 10**15, 2)], [(3, 2, 1), (4, 3, 1)]]
    schema = "seq BIGINT, ts_ns BIGINT, k BIGINT"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        os.utime(next((tmp_path / f"in/part{i}").glob("part-*")), (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    rates = {"window_ns": 10, "threshold": 2}
    run_to_end(rate_batches(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["k"], "ts_ns", ["seq"],
                            trigger={"availableNow": True}, **rates))
    got = {r.seq: (r.window_start, r.n, r.limited) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    want = nl.rate_check(spark.createDataFrame(sum(batches, []), schema), ["k"], "ts_ns", ["seq"], **rates)
    assert got == {r.seq: (r.window_start, r.n, r.limited) for r in want.collect()}


def test_rate_stream_resumes_from_its_checkpoint(spark, tmp_path):
    rows = rate_rows(6)
    options = {"window_ns": 25_000_000, "threshold": 2}

    def run():
        stream = read_table_stream(spark, str(tmp_path / "in"), RATE, max_files=1)
        return collect_stream(spark, rate_stream(stream, ["k"], "ts_ns", ["seq"], **options), tmp_path)

    write_parts(spark, rows[:200], RATE, tmp_path / "in", 2)
    run()
    write_parts(spark, rows[200:], RATE, tmp_path / "in", 2)
    got = {r.seq: (r.window_start, r.n) for r in run().collect()}
    want = nl.rate_check(spark.createDataFrame(rows, RATE), ["k"], "ts_ns", ["seq"], **options)
    assert got == {r.seq: (r.window_start, r.n) for r in want.collect()}


def test_late_row_counts_in_the_open_window(spark, tmp_path):
    write_parts(spark, [(1, 100, 0, 0), (1, 200, 1, 0), (1, 50, 2, 0), (1, 205, 3, 0)], RATE, tmp_path / "in", 4)
    stream = read_table_stream(spark, str(tmp_path / "in"), RATE, max_files=1)
    got = collect_stream(spark, rate_stream(stream, ["k"], "ts_ns", ["seq"], window_ns=50), tmp_path)
    assert [(r.window_start, r.n, r.late) for r in got.orderBy("seq").collect()] == [
        (100, 1, False), (200, 1, False), (200, 2, True), (200, 3, False)
    ]


def test_pair_calls_stream_equals_batch(spark, tmp_path):
    rng, rows = random.Random(8), []
    for i in range(300):
        kind = rng.choice(["enter", "exit"])
        rows.append((i, i // 2, 1, rng.randint(0, 3), kind, i if kind == "enter" else None,
                     rng.choice([-1, 3, 2000]) if kind == "exit" else None,
                     bytearray(b"y" * 2500) if kind == "exit" else None))
    write_parts(spark, rows, PROBE_EVENTS, tmp_path / "in", 3)
    stream = read_table_stream(spark, str(tmp_path / "in"), PROBE_EVENTS, max_files=1)
    got = collect_stream(spark, pair_calls_stream(stream), tmp_path)
    want = nl.pair_calls(spark.createDataFrame(rows, PROBE_EVENTS))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("options", [{}, {"hot_rows": 30, "chunk_rows": 9}])
def test_pair_calls_batches_equals_batch_on_a_hot_thread(spark, tmp_path, options):
    rng, rows = random.Random(12), []
    for i in range(400):
        kind = rng.choice(["enter", "exit"])
        rows.append((i, i // 2, 1, 0 if i % 5 else rng.randint(1, 4), kind, i if kind == "enter" else None,
                     rng.choice([-1, 3, 2000]) if kind == "exit" else None, bytearray(b"y" * 2500) if kind == "exit" else None))
    write_parts(spark, rows, PROBE_EVENTS, tmp_path / "in", 4)
    stream = read_table_stream(spark, str(tmp_path / "in"), PROBE_EVENTS, max_files=1)
    run_to_end(pair_calls_batches(
        stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger={"availableNow": True}, max_bytes=100, **options))
    want = nl.pair_calls(spark.createDataFrame(rows, PROBE_EVENTS), max_bytes=100)
    got = spark.read.parquet(str(tmp_path / "out/pairs")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # open calls of the last two micro-batches, and no more
    assert len(list((tmp_path / "out/open").iterdir())) == 2


def test_carry_is_that_of_the_micro_batch_before(spark, tmp_path):
    for batch in range(3):
        write_carry(spark.createDataFrame([(batch,)], "v BIGINT"), str(tmp_path), batch)
    schema = spark.createDataFrame([], "v BIGINT").schema
    assert [r.v for r in read_carry(spark, str(tmp_path), 3, schema).collect()] == [2]
    assert [r.v for r in read_carry(spark, str(tmp_path), 2, schema).collect()] == [1]  # repeated
    assert read_carry(spark, str(tmp_path), 0, schema).count() == 0
    with pytest.raises(ValueError):
        read_carry(spark, str(tmp_path), 1, schema)


def arrivals(n=60):
    """Pointer events and their payloads; some share a payload, some claim a byte too many, some have none."""
    events, stored = [], []
    for i in range(n):
        body = b'{"n":%d}' % (i // 2)
        if i % 2 == 0 and i % 10:
            stored.append((i // 2, i, 0, bytearray(body)))
        events.append((i, "sk_msg", None, None, None, i, True, i // 2, len(body) + (i % 7 == 0), None))
    events.append((n, "sk_msg", None, None, None, n, True, None, 5, None))
    events.append((n + 1, "tc", None, None, None, n, False, None, 2, bytearray(b"{}")))
    return events, stored


@pytest.mark.parametrize("first", ["events", "payloads", "mixed"])
def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path, first):
    events, stored = arrivals()
    rng = random.Random(first)
    rng.shuffle(events)
    rng.shuffle(stored)
    paths = {"events": str(tmp_path / "events"), "payloads": str(tmp_path / "payloads")}
    for kind, schema in (("events", CAPTURE_EVENTS), ("payloads", PAYLOADS)):
        spark.createDataFrame([], schema).write.parquet(paths[kind])

    def run():
        query = stream_event_logs(
            read_table_stream(spark, paths["events"], CAPTURE_EVENTS, max_files=1), str(tmp_path / "out"), str(tmp_path / "ckpt"),
            payloads=read_table_stream(spark, paths["payloads"], PAYLOADS, max_files=1), wait_ns=10**9, availableNow=True)
        run_to_end(query)

    steps = [("events", events[:30]), ("events", events[30:]), ("payloads", stored[:10]), ("payloads", stored[10:])]
    steps = {"events": steps, "payloads": steps[::-1], "mixed": [steps[i] for i in (2, 0, 3, 1)]}[first]
    for kind, rows in steps:
        write_parts(spark, rows, CAPTURE_EVENTS if kind == "events" else PAYLOADS, paths[kind], 2)
        run()
    flush_event_logs(spark, str(tmp_path / "out"), CAPTURE_EVENTS, payloads=True)
    batch = nl.parse_logs(nl.resolve_payloads(spark.createDataFrame(events, CAPTURE_EVENTS), spark.createDataFrame(stored, PAYLOADS)))
    want = sorted((r.channel, r.value) for r in log_lines(batch).collect())
    assert lines(spark, str(tmp_path / "out")) == want


def test_waiting_ends_with_the_clock(spark, tmp_path):
    paths = str(tmp_path / "events"), str(tmp_path / "payloads")
    spark.createDataFrame([], PAYLOADS).write.parquet(paths[1])

    def step(rows, stored=()):
        write_parts(spark, rows, CAPTURE_EVENTS, paths[0], 1)
        if stored:
            write_parts(spark, list(stored), PAYLOADS, paths[1], 1)
        run_to_end(stream_event_logs(
            read_table_stream(spark, paths[0], CAPTURE_EVENTS), str(tmp_path / "out"), str(tmp_path / "ckpt"),
            payload_table=paths[1], wait_ns=100, availableNow=True))
        return lines(spark, str(tmp_path / "out"))

    def pointer(seq, ts):
        return (seq, "sk_msg", None, None, None, ts, True, seq, 2, None)

    assert step([pointer(0, 0), pointer(1, 50)]) == []
    assert step([pointer(2, 90)], [(1, 0, 0, bytearray(b"{}"))]) == [("logs", "{}")]
    # 150 is past 0 + 100, not past 90 + 100
    found = step([pointer(3, 150)])
    assert [json.loads(v)["seq"] for c, v in found if c == "rejects"] == [0]
    # the payload of a rejected event is too late; that of a waiting one is not
    found = step([pointer(4, 160)], [(0, 0, 0, bytearray(b"{}")), (2, 0, 0, bytearray(b"{}"))])
    assert [json.loads(v)["seq"] for c, v in found if c == "rejects"] == [0] and len(found) == 3


def test_first_seen_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 1000), rng.choice(["active_established", "close"]), rng.randint(0, 9), f"c{i}") for i in range(200)]
    write_parts(spark, rows, CONN_EVENTS, tmp_path / "in", 3)
    stream = nl.first_seen(read_table_stream(spark, str(tmp_path / "in"), CONN_EVENTS, max_files=1))
    latest = {}

    def keep(batch, batch_id):
        latest.update({r.local_port: tuple(r) for r in batch.collect()})

    run_to_end(stream.writeStream.foreachBatch(keep).outputMode("update")
               .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    want = {r.local_port: tuple(r) for r in nl.first_seen(spark.createDataFrame(rows, CONN_EVENTS)).collect()}
    assert latest == want


def packets(n):
    rng, rows = random.Random(4), []
    bodies = [b'{"a":1}', b'{"a":', b'[1]', b'{"b":[true,null]}']
    for i in range(n):
        rows.append((i, i * 1000, bytearray(frame(
            dport=rng.choice([443, 8080, 9]), src=0x0A000000 + rng.randint(0, 3), payload=rng.choice(bodies)
        ))))
    return rows


def lines(spark, path):
    got = spark.read.text(path)
    if "channel" not in got.columns:  # nothing was written yet
        return []
    return sorted((r.channel, r.value) for r in got.select("channel", "value").collect())


def test_stream_logs_equals_batch_and_follows_the_interest_list(spark, tmp_path):
    rows = packets(120)
    write_parts(spark, rows, FRAMES, tmp_path / "in", 3)
    config = tmp_path / "intercept.yaml"
    config.write_text("intercept:\n  - port: 443\n    protocol: tcp\n")

    def run():
        stream_logs_query = stream_logs(
            read_table_stream(spark, str(tmp_path / "in"), FRAMES, max_files=1), str(tmp_path / "out"),
            str(tmp_path / "ckpt"), interest_table=str(tmp_path / "loads"), interest_config=str(config), availableNow=True,
        )
        run_to_end(stream_logs_query)

    run()
    interest = spark.createDataFrame([(443, 6, None)], INTEREST)
    df = spark.createDataFrame(rows, FRAMES)
    run_batch(spark, str(tmp_path / "batch"), frames=df, interest=interest)
    assert [v for _, v in lines(spark, str(tmp_path / "out"))] == _without_source(lines(spark, str(tmp_path / "batch/logs")))
    assert {c for c, _ in lines(spark, str(tmp_path / "out"))} == {"logs", "rejects"}

    config.write_text("intercept:\n  - port: 8080\n    protocol: tcp\n")
    before = len(lines(spark, str(tmp_path / "out")))
    more = [(1000 + i, i, bytearray(frame(dport=port, payload=b"{}"))) for i, port in enumerate([443, 8080, 9])]
    write_parts(spark, more, FRAMES, tmp_path / "in", 1)
    run()
    assert len(lines(spark, str(tmp_path / "out"))) == before + 2


def test_a_stream_survives_a_bad_configuration_file(spark, tmp_path):
    config = tmp_path / "intercept.yaml"

    def run(text, n):
        config.write_text(text)
        os.utime(config, (1000 + n, 1000 + n))
        write_parts(spark, [(n, n, bytearray(frame(dport=443, payload=b"{}")))], FRAMES, tmp_path / "in", 1)
        run_to_end(stream_logs(
            read_table_stream(spark, str(tmp_path / "in"), FRAMES), str(tmp_path / "out"), str(tmp_path / "ckpt"),
            interest_table=str(tmp_path / "loads"), interest_config=str(config), availableNow=True))
        return len(lines(spark, str(tmp_path / "out")))

    assert run("intercept:\n  - port: 443\n    protocol: tcp\n", 0) == 1
    for i, bad in enumerate(["intercept: 2001-13-45\n", "intercept: " + "[" * 5_000, "intercept: !!int ''\n"], 1):
        assert run(bad, i) == 1 + i


def _without_source(found):
    out = []
    for channel, value in found:
        if channel == "rejects":
            reject = json.loads(value)
            reject.pop("source")
            value = json.dumps(reject, separators=(",", ":"))
        out.append(value)
    return out


def test_stream_of_capture_events(spark, tmp_path):
    rows = [
        (0, "tc", None, None, None, 1, False, None, 7, bytearray(b'{"a":1}xx')), (1, "sk_msg", None, None, None, 2, True, 5, 8, None),
        (2, "sk_msg", None, None, None, 3, True, 6, 8, None), (3, "tls", None, 1, 1, 4, False, None, 3, bytearray(b"{x}")),
    ]
    write_parts(spark, rows, CAPTURE_EVENTS, tmp_path / "in", 2)
    spark.createDataFrame([(5, 0, 0, bytearray(b'{"b":22}'))], PAYLOADS).write.parquet(str(tmp_path / "payloads"))
    query = stream_event_logs(
        read_table_stream(spark, str(tmp_path / "in"), CAPTURE_EVENTS, max_files=1), str(tmp_path / "out"),
        str(tmp_path / "ckpt"), payload_table=str(tmp_path / "payloads"), availableNow=True,
    )
    run_to_end(query)
    found = lines(spark, str(tmp_path / "out"))
    assert [v for c, v in found if c == "logs"] == ['{"a":1}', '{"b":22}']
    assert sorted(json.loads(v)["reject_reason"] for c, v in found if c == "rejects") == ["bad_json", "bad_ref"]


def test_edge_verdict_on_a_stream(spark, tmp_path):
    rows = packets(90)
    write_parts(spark, rows, FRAMES, tmp_path / "in", 3)
    interest = spark.createDataFrame([(443, 6, None), (8080, 6, None)], INTEREST)
    allow = spark.createDataFrame([(31, 0x0A000000)], ALLOWLIST)
    options = {"window_ns": 20_000, "threshold": 1}
    columns = ["seq", "edge_reason", "rate_window_start", "rate_count", "rate_limited"]
    flows = nl.decode_frames(read_table_stream(spark, str(tmp_path / "in"), FRAMES, max_files=1)).drop("frame")
    got = collect_stream(spark, nl.edge_verdict(flows, interest, allow, check=rate_stream, **options), tmp_path)
    batch = nl.decode_frames(spark.createDataFrame(rows, FRAMES)).drop("frame")
    want = nl.edge_verdict(batch, interest, allow, **options)
    assert {r.seq: tuple(r) for r in got.select(columns).collect()} == {r.seq: tuple(r) for r in want.select(columns).collect()}


def test_run_batch_with_all_producers(spark, tmp_path):
    interest = spark.createDataFrame([(443, 6, None), (8080, 6, None)], INTEREST)
    frames = spark.createDataFrame(packets(40), FRAMES)
    big = b'{"m":"' + b"x" * 5000 + b'"}'
    messages = spark.createDataFrame(
        [(0, 1, 80, 6, "c", bytearray(big)), (1, 2, 80, 6, "c", bytearray(b"x" * 70_000)), (2, 3, 81, 6, "c", bytearray(big))], MESSAGES
    )
    conns = spark.createDataFrame([(0, 1, "passive_established", 80, "c")], CONN_EVENTS)
    calls = spark.createDataFrame(
        [(0, 1, 7, 8, "enter", 1, None, None), (1, 2, 7, 8, "exit", None, 7, bytearray(b'{"t":1}garbage'))], PROBE_EVENTS
    )
    out = run_batch(
        spark, str(tmp_path / "out"), frames=frames, interest=interest, messages=messages, conn_events=conns,
        probe_events=calls, window_ns=10_000, threshold=1,
    )
    found = lines(spark, str(tmp_path / "out/logs"))
    assert ("logs", '{"t":1}') in found and ("logs", big.decode()) in found
    rejected = [json.loads(v) for c, v in found if c == "rejects"]
    assert sum(r["source"] == "sk_msg" for r in rejected) == 1
    assert out["flows"].count() == out["verdicts"].count() == 40
    assert sum(r.rows for r in out["edge_counts"].collect()) == 40


@pytest.mark.parametrize("wait_ns", [None, 10**12])
def test_run_stream_equals_run_batch_also_after_a_restart(spark, tmp_path, wait_ns):
    rng = random.Random(6)
    big = b'{"m":"' + b"x" * 3000 + b'"}'
    rows = {
        "frames": (packets(90), FRAMES),
        "conn_events": ([(i, i, "passive_established", 80 + i, f"c{i}") for i in range(3)], CONN_EVENTS),
        "messages": ([(i, 10 + i, 80 + i % 5, 6, "c", bytearray(big + b" " * i)) for i in range(30)], MESSAGES),
        "probe_events": ([(i, i, 1, rng.randint(0, 2), kind, i if kind == "enter" else None, 7 if kind == "exit" else None,
                           bytearray(b'{"t":1}garbage') if kind == "exit" else None)
                          for i, kind in enumerate(rng.choice(["enter", "exit"]) for _ in range(80))], PROBE_EVENTS),
        "records": ([(i, bytearray(record(8, b'{"r": 1}', is_ref=i % 2, offset=i // 2, ts=i))) for i in range(40)], "seq BIGINT, record BINARY"),
    }
    config = tmp_path / "intercept.yaml"
    config.write_text("intercept:\n  - {port: 443, protocol: tcp}\n  - {port: 8080, protocol: tcp}\n")
    allow = spark.createDataFrame([(31, 0x0A000000), (32, 0x0A000002)], ALLOWLIST)
    out = str(tmp_path / "out")

    def feed(share):
        for name, (made, schema) in rows.items():
            # connections come first, so that every message finds its endpoint
            half = len(made) if name == "conn_events" else len(made) // 2
            part = made[:half] if share == 0 else made[half:]
            if part:
                write_parts(spark, part, schema, tmp_path / name, 1)

    def run():
        run_to_end(run_stream(
            out, str(tmp_path / "ckpt"), interest_table=str(tmp_path / "loads"), interest_config=str(config), allowlist=allow,
            window_ns=20_000, threshold=1, wait_ns=wait_ns, availableNow=True,
            **{name: read_table_stream(spark, str(tmp_path / name), schema, max_files=1) for name, (_, schema) in rows.items()}))

    feed(0)
    run()
    feed(1)
    run()
    batch = run_batch(
        spark, str(tmp_path / "batch"), interest=spark.createDataFrame([(443, 6, None), (8080, 6, None)], INTEREST), allowlist=allow,
        window_ns=20_000, threshold=1, **{name: spark.createDataFrame(made, schema) for name, (made, schema) in rows.items()})

    def stored(name, columns):
        return sorted(map(tuple, spark.read.parquet(f"{out}/{name}").select(columns).collect()), key=repr)

    for name in ("flows", "verdicts"):
        assert stored(name, batch[name].columns) == sorted(map(tuple, batch[name].collect()), key=repr)
    want = lines(spark, str(tmp_path / "batch/logs"))
    if wait_ns is None:  # pointers of records that come before their message are rejected then
        want = [line for line in want if '"source":"records"' not in line[1] and line[1] != '{"m"' and line[0] == "logs"]
        assert {line for line in want} <= set(lines(spark, f"{out}/logs"))
    else:
        waiting = spark.read.parquet(f"{out}/state/waiting").where("_waits").groupBy("_batch_id").count().orderBy(F.desc("_batch_id")).first()
        got = lines(spark, f"{out}/logs")
        assert set(got) <= set(want) and len(want) - len(got) == waiting["count"]
        assert all('"bad_ref"' in line[1] for line in set(want) - set(got))
    counts = {(r.kind, r.reason): r.rows for r in stream_counts(spark, out).collect()}
    assert {k[1]: n for k, n in counts.items() if k[0] == "edge"} == {r.edge_reason: r.rows for r in batch["edge_counts"].collect()}
    assert {k[1]: n for k, n in counts.items() if k[0] == "capture"} == {r.capture_reason: r.rows for r in batch["capture_counts"].collect()}


def test_appended_records_are_read_once_and_half_ones_wait(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RANGE_RECORDS", 2)
    folder = tmp_path / "capture"
    folder.mkdir()
    items = [record(7, b'{"a":%d}' % i, conn=i) for i in range(9)]

    def append(name, data):
        with open(folder / name, "ab") as file:
            file.write(data)

    def run():
        stream = nl.decode_records(read_records_stream(spark, str(folder)))
        query = stream.select("path", "record_no", "conn_id", "reject_reason").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "ckpt")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run_to_end(query)
        return sorted((r.path.split("/")[-1], r.record_no, r.conn_id, r.reject_reason) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    append("one", b"".join(items[:5]) + items[5][:100])
    append("_ignored", items[8])
    assert run() == [("one", i, i, None) for i in range(5)]
    append("one", items[5][100:] + items[6])
    append("two", items[7])
    want = [("one", i, i, None) for i in range(7)] + [("two", 0, 7, None)]
    assert run() == want
    assert run() == want


@pytest.mark.parametrize("by", [[], ["k"]])
def test_retain_batches_equals_batch(spark, tmp_path, by):
    rng = random.Random(15)
    rows = [(rng.randint(0, 4), rng.randint(0, 50), i, i) for i in range(200)]
    write_parts(spark, rows, RATE, tmp_path / "in", 4)
    stream = read_table_stream(spark, str(tmp_path / "in"), RATE, max_files=1)
    run_to_end(retain_batches(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), 7, by=by, trigger={"availableNow": True}))
    want = nl.retain_latest(spark.createDataFrame(rows, RATE), 7, by=by)
    got = retained(spark, str(tmp_path / "out"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parts_in_order_are_written_by_all_tasks_and_taken_as_one_batch(spark, tmp_path):
    from netlog.plans.streams import run_in_order

    rows = spark.range(900, numPartitions=4).select(F.col("id").alias("seq"), (F.col("id") * 7 % 900).alias("ts_ns"))
    few = spark.createDataFrame([(1, None), (2, None)], "seq BIGINT, ts_ns BIGINT")
    seen = []

    def start(rows, few):
        both = rows.withColumn("name", F.lit("rows")).unionByName(few.withColumn("name", F.lit("few")))

        def write_batch(batch, batch_id):
            got = batch.where("name = 'rows'").agg(F.count("*"), F.min("ts_ns"), F.max("ts_ns")).first()
            seen.append((batch_id, *got, batch.where("name = 'few'").count()))

        return both.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()

    run_in_order(start, f"{tmp_path}/in", rows=rows, few=few)
    assert [s[0] for s in seen] == [0, 1, 2] and [s[4] for s in seen] == [2, 0, 0]
    assert sum(s[1] for s in seen) == 900 and all(250 < s[1] < 350 for s in seen)
    assert all(a[3] < b[2] for a, b in zip(seen, seen[1:]))
    # no task has a whole part
    files = [spark.read.parquet(str(f)).count() for f in (tmp_path / "in" / "rows").glob("*.parquet")]
    assert len(files) == 12 and max(files) < 150
