import random

from pyspark.sql import functions as F

import netlog as nl
from netlog.operators.skew import hot_chunks, hot_keys

SCHEMA = "k BIGINT, ts BIGINT, seq BIGINT"


def burst_rows():
    """Key 0 is hot: half its rows lie in a hundredth of its time. Keys 1 to 50 are not."""
    rng = random.Random(1)
    times = [rng.randint(0, 100_000) for _ in range(1_000)] + [rng.randint(50_000, 51_000) for _ in range(1_000)]
    times += [0, 100_000]
    rows = [(0, t, i) for i, t in enumerate(times)]
    return rows + [(1 + i % 50, rng.randint(0, 100_000), 10_000 + i) for i in range(500)]


def test_hot_key_is_cut_by_rate_and_again_where_it_bursts(spark):
    df = spark.createDataFrame(burst_rows(), SCHEMA)
    hot = hot_keys(df, ["k"], "ts", min_chunk_ns=10, hot_rows=100, chunk_rows=100)
    chunked = hot_chunks(df, hot, ["k"], "ts", min_chunk_ns=10, chunk_rows=100)
    assert chunked.count() == df.count()
    assert chunked.where("k > 0 AND _chunk IS NOT NULL").count() == 0
    hot = chunked.where("k = 0")
    assert hot.where("_chunk IS NULL OR _chunk > ts").count() == 0
    sizes = [r["count"] for r in hot.groupBy("_chunk").count().collect()]
    assert max(sizes) <= 300 and len(sizes) >= 20
    # chunks do not overlap: in time order a chunk never comes back
    order = [r._chunk for r in hot.orderBy("ts").collect()]
    assert order == sorted(order)


def test_rate_and_pairs_are_the_same_on_a_burst(spark):
    df = spark.createDataFrame(burst_rows(), SCHEMA)
    options = {"window_ns": 40, "threshold": 2}
    plain = nl.rate_check(df, ["k"], "ts", ["seq"], hot_rows=None, **options)
    cut = nl.rate_check(df, ["k"], "ts", ["seq"], hot_rows=100, chunk_rows=50, chunk_windows=2, **options)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    calls = df.select(
        F.lit(1).cast("bigint").alias("pid"), F.col("k").alias("tid"), F.col("ts").alias("ts_ns"), "seq",
        F.when(F.pmod(F.xxhash64("seq"), F.lit(2)) == 0, "enter").otherwise("exit").alias("kind"),
        F.col("seq").alias("buf"), F.pmod("seq", F.lit(3)).cast("int").alias("ret"), F.lit(b"abc").alias("data"),
    )
    plain = nl.pair_calls(calls, hot_rows=None)
    cut = nl.pair_calls(calls, hot_rows=100, chunk_rows=50)
    assert plain.count() > 100
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_without_a_hot_key_there_are_no_chunk_branches(spark):
    df = spark.createDataFrame(burst_rows(), SCHEMA)
    checked = nl.rate_check(df, ["k"], "ts", ["seq"], window_ns=40)
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "Join" not in final and "Union" not in final
    assert final.count("Exchange hashpartitioning") == 1 and final.count("Scan Existing") == 1
