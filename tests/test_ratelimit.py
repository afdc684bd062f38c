import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import netlog as nl
from netlog.operators.bursts import burst_entries
from netlog.operators.ratelimit import _ChunkSummary

SCHEMA = "k BIGINT, ts BIGINT, seq BIGINT"


def expected(rows, window):
    """(window start, place) per row, by a plain loop."""
    out, state = {}, {}
    for k, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        start, count = state.get(k, (None, 0))
        if start is None or ts - start > window:
            start, count = ts, 1
        else:
            count += 1
        state[k] = (start, count)
        out[seq] = (start, count)
    return out


def run(spark, rows, window, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    checked = nl.rate_check(df, ["k"], "ts", ["seq"], window_ns=window, threshold=2, **options).collect()
    assert len(checked) == len(rows)
    assert all(r.limited == (r.n > 2) for r in checked)
    return {r.seq: (r.window_start, r.n) for r in checked}


def test_fixture(spark):
    times = [0, 1, 2, 1_000_000_000, 1_000_000_001, 1_000_000_001]
    df = spark.createDataFrame([(7, t, i) for i, t in enumerate(times)], SCHEMA)
    got = nl.rate_check(df, ["k"], "ts", ["seq"], threshold=2).orderBy("seq").collect()
    assert [(r.window_start, r.n, r.limited) for r in got] == [
        (0, 1, False), (0, 2, False), (0, 3, True), (0, 4, True), (1_000_000_001, 1, False), (1_000_000_001, 2, False)
    ]


def make_rows(rng, keys, n, gaps):
    rows, seq = [], 0
    for k in range(keys):
        t = rng.randint(-50, 50)
        for _ in range(n):
            t += rng.choice(gaps)
            rows.append((k, t, seq))
            seq += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,gaps", [
    (1, [0, 1, 3, 10, 11]), (2, [1]), (3, [0, 0, 0, 25]), (4, [10]), (5, [11]), (6, [2, 500]), (7, [0, 1, 2, 3, 4])
])
def test_hot_keys_match_the_loop(spark, seed, gaps):
    rows = make_rows(random.Random(seed), 3, 250, gaps)
    want = expected(rows, 10)
    assert run(spark, rows, 10) == want
    for chunk_windows, chunk_rows in ((1, 5), (2, 1), (4, 60)):
        got = run(spark, rows, 10, hot_rows=100, chunk_rows=chunk_rows, chunk_windows=chunk_windows)
        assert got == want


def test_one_hot_key_among_many(spark):
    rng = random.Random(11)
    hot = [(0, rng.randint(0, 5_000), i) for i in range(1_500)]
    cold = [(rng.randint(1, 300), rng.randint(0, 5_000), 1_500 + i) for i in range(1_500)]
    rows = hot + cold
    assert run(spark, rows, 40, hot_rows=500, chunk_rows=50, chunk_windows=2) == expected(rows, 40)


def test_several_batches_per_chunk(spark):
    rng = random.Random(12)
    rows = [(i % 2, rng.randint(0, 3_000), i) for i in range(2_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert run(spark, rows, 50, hot_rows=100, chunk_rows=300, chunk_windows=3) == expected(rows, 50)
        assert run(spark, rows, 50) == expected(rows, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


BURST = {"hot_rows": 100, "chunk_rows": 30, "chunk_windows": 64, "burst_rows": 60}


@pytest.mark.parametrize("seed,gaps", [
    (1, [0, 1, 3, 10, 11]), (3, [0, 0, 0, 25]), (4, [10]), (5, [11]), (6, [2, 500]), (7, [0] * 30 + [1]), (8, [1] * 60 + [900])
])
def test_bursts_match_the_loop(spark, seed, gaps):
    rows = make_rows(random.Random(seed), 3, 250, gaps)
    assert run(spark, rows, 10, **BURST) == expected(rows, 10)


def test_a_burst_within_one_window_is_spread(spark):
    """All but a few rows of one key lie within one window: the scan deals them out all the same."""
    rng = random.Random(3)
    rows = [(0, rng.randint(0, 900_000), i) for i in range(6_000)] + [(0, 3_000_000 + i, 6_000 + i) for i in range(300)]
    rows += [(1, i, 7_000 + i) for i in range(50)]
    options = {"hot_rows": 500, "chunk_rows": 400, "burst_rows": 1_000}
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(spark, rows, 1_000_000, **options) == expected(rows, 1_000_000)
    bursting = spark.createDataFrame([(0, 6_300)], "k BIGINT, _rows BIGINT")
    pieces, entries = burst_entries(df.where("k = 0"), bursting, ["k"], "ts", window_ns=1_000_000, chunk_rows=400)
    sizes = [r["count"] for r in pieces.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1_200 and sum(sizes) == 6_300
    assert entries.count() == len(sizes) - 1


def test_bursting_keys_that_are_null_or_text(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), rng.randint(0, 90), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k STRING, ts BIGINT, seq BIGINT")
    got = {r.seq: (r.window_start, r.n) for r in nl.rate_check(df, ["k"], "ts", ["seq"], window_ns=20, **BURST).collect()}
    assert got == expected(rows, 20)


@pytest.mark.parametrize("options", [
    {"hot_rows": None}, {}, {"hot_rows": 40, "chunk_rows": 15, "chunk_windows": 1}, {"hot_rows": 40, "chunk_rows": 60},
    {"hot_rows": 40, "chunk_rows": 15, "burst_rows": 20},
])
def test_going_on_from_open_windows(spark, options):
    rng, rows = random.Random(21), []
    for i in range(600):
        rows.append((rng.randint(0, 3), rng.randint(0, 900), i))
    rows.sort(key=lambda r: r[1])
    # some rows of the second part come from before the windows the first part left open
    first, second = rows[:300], rows[300:] + [(k, 300 + 7 * k, 600 + k) for k in range(4)]
    part = nl.rate_check(spark.createDataFrame(first, SCHEMA), ["k"], "ts", ["seq"], window_ns=30)
    opened = nl.open_windows(part, ["k"])
    state = {r.k: (r.window_start, r.n) for r in opened.collect()}
    want = {}
    for k, ts, seq in sorted(second, key=lambda r: (r[1], r[2])):
        start, count = state[k]
        state[k] = want[seq] = (ts, 1) if ts - start > 30 else (start, count + 1)
    df = spark.createDataFrame(second, SCHEMA)
    checked = nl.rate_check(df, ["k"], "ts", ["seq"], window_ns=30, opened=opened, **options)
    assert {r.seq: (r.window_start, r.n) for r in checked.collect()} == want
    assert {r.k: (r.window_start, r.n) for r in nl.open_windows(checked, ["k"], opened=opened).collect()} == state


def test_null_and_text_keys(spark):
    rows = [(None, 1, 0), (None, 2, 1), ("a", 1, 2), ("b", 2, 3), ("a", 3, 4), (None, 3, 5)]
    df = spark.createDataFrame(rows, "k STRING, ts BIGINT, seq BIGINT")
    for options in ({}, {"hot_rows": 1, "chunk_rows": 1, "chunk_windows": 1}):
        got = {r.seq: r.n for r in nl.rate_check(df, ["k"], "ts", ["seq"], window_ns=10, **options).collect()}
        assert got == {0: 1, 1: 2, 2: 1, 3: 1, 4: 2, 5: 3}


def test_null_time_is_an_error(spark):
    df = spark.createDataFrame([(1, None, 0)], SCHEMA)
    with pytest.raises(Exception, match="has NULLs"):
        nl.rate_check(df, ["k"], "ts", ["seq"], hot_rows=None).collect()


def test_threshold_column_and_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], SCHEMA).withColumn("note", F.lit("x"))
    got = nl.rate_check(df, ["k"], "ts", ["seq"], threshold=F.col("seq")).orderBy("seq").collect()
    assert [(r.note, r.n, r.limited) for r in got] == [("x", 1, True), ("x", 2, True)]


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 10), st.integers(1, 7), st.data())
def test_chunk_summary_is_the_exact_step_function(gaps, window, batch, data):
    import numpy as np

    times = np.cumsum(np.array(gaps, dtype=np.int64))
    summary = _ChunkSummary(0, window)
    for i in range(0, len(times), batch):
        summary.add(times[i:i + batch])
    upto, starts, counts, passes = summary.exits()
    assert list(upto) == sorted(set(upto.tolist()))
    for _ in range(5):
        start = data.draw(st.integers(-2 * window, -1))
        state, count = start, 1
        for t in times.tolist():
            state, count = (t, 1) if t - state > window else (state, count + 1)
        i = int(np.searchsorted(upto, start + window, side="right"))
        got = (start, 1 + int(counts[i])) if passes[i] else (int(starts[i]), int(counts[i]))
        assert got == (state, count)
