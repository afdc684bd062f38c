import random

import netlog as nl
from netlog.schemas import CONN_EVENTS, MESSAGES, PROBE_EVENTS

DATA = bytearray(b"x" * 3000)
FIXTURE = [
    (0, 1, 1, 1, "enter", 100, None, None), (1, 2, 1, 1, "exit", None, -1, DATA), (2, 3, 1, 1, "exit", None, 5, DATA),
    (3, 4, 1, 1, "exit", None, 7, DATA), (4, 5, 1, 1, "enter", 200, None, None), (5, 6, 1, 1, "enter", 201, None, None),
    (6, 7, 1, 1, "exit", None, 2000, DATA), (7, 1, 1, 2, "exit", None, 3, DATA),
]


def test_fixture(spark):
    df = spark.createDataFrame(FIXTURE, PROBE_EVENTS)
    for options in ({}, {"hot_rows": None}, {"hot_rows": 1, "chunk_rows": 1}):
        whole = nl.pair_calls(df, **options).collect()
        assert {(r.tid, r.ts_ns, r.buf, r.data_len) for r in whole} == {(1, 3, 100, 5), (1, 7, 201, 2000)}
        rows = nl.pair_calls(df, max_bytes=1024, **options).collect()
        assert {(r.tid, r.ts_ns, r.buf, r.data_len) for r in rows} == {(1, 3, 100, 5), (1, 7, 201, 1024)}
        assert {(r.original_size, r.truncated) for r in rows} == {(5, False), (2000, True)}
        assert all(len(r.data) == r.data_len for r in rows)


def test_chunked_threads_match_the_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        kind = rng.choice(["enter", "exit"])
        thread = 0 if rng.random() < 0.7 else rng.randint(1, 5)
        rows.append((i, rng.randint(0, 400), 1, thread, kind, i * 10 if kind == "enter" else None,
                     rng.choice([-1, 0, 4]) if kind == "exit" else None, DATA if kind == "exit" else None))
    want, stored = set(), {}
    for seq, ts, _, tid, kind, buf, ret, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "enter":
            stored[tid] = (buf, ts)
        elif ret > 0 and tid in stored:
            want.add((tid, seq, *stored.pop(tid)))
    df = spark.createDataFrame(rows, PROBE_EVENTS)
    for options in ({}, {"hot_rows": 50, "chunk_rows": 7}, {"hot_rows": 0, "chunk_rows": 100}):
        got = [(r.tid, r.seq, r.buf, r.enter_ns) for r in nl.pair_calls(df, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_going_on_from_open_calls(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        kind = rng.choice(["enter", "exit", "other"])
        thread = 0 if rng.random() < 0.6 else rng.randint(1, 9)
        rows.append((i, i // 2, 1, thread, kind, i * 10 if kind == "enter" else None,
                     rng.choice([-1, 0, 4]) if kind == "exit" else None, DATA if kind == "exit" else None))
    whole = nl.pair_calls(spark.createDataFrame(rows, PROBE_EVENTS))
    want = {(r.tid, r.seq, r.buf, r.enter_ns) for r in whole.collect()}
    for options in ({}, {"hot_rows": None}, {"hot_rows": 20, "chunk_rows": 7}):
        got, opened = [], None
        for start in range(0, 600, 200):
            part = spark.createDataFrame(rows[start:start + 200], PROBE_EVENTS)
            got += [(r.tid, r.seq, r.buf, r.enter_ns) for r in nl.pair_calls(part, opened=opened, **options).collect()]
            left = nl.open_calls(part, opened=opened)
            opened = spark.createDataFrame(left.collect(), left.schema)
        assert len(got) == len(set(got)) and set(got) == want


def test_first_seen(spark):
    rows = [
        (0, 5, "active_established", 8080, "b"), (1, 4, "passive_established", 8080, "a"), (2, 1, "close", 8080, "x"),
        (3, 9, "active_established", 8080, "c"), (4, 4, "passive_established", 8080, "d"), (5, 2, "listen", 90, "y"),
    ]
    got = nl.first_seen(spark.createDataFrame(rows, CONN_EVENTS)).collect()
    assert [(r.local_port, r.proto, r.conn_key, r.ts_ns) for r in got] == [(8080, 6, "a", 4)]


def test_registered_messages(spark):
    registry = nl.first_seen(spark.createDataFrame([(0, 1, "active_established", 80, "a")], CONN_EVENTS))
    rows = [(0, 1, 80, 6, "a", DATA), (1, 1, 80, 6, "b", DATA), (2, 1, 80, 17, "a", DATA), (3, 1, 81, 6, "a", DATA)]
    messages = spark.createDataFrame(rows, MESSAGES)
    assert sorted(r.seq for r in nl.registered_messages(messages, registry).collect()) == [0, 1]
    assert [r.seq for r in nl.registered_messages(messages, registry, per_connection=True).collect()] == [0]
