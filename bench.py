"""Time the registered queries and a few larger cases; print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query runs once to warm up and is then timed from
building its plan to its last row.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import netlog as nl  # noqa: E402
from netlog.plans import queries as q  # noqa: E402

HEADLINE = (
    "captured_fields", "decode_flows", "capture_inline", "allowlist_lpm", "edge_verdict", "rate_check",
    "rate_check_hot", "json_parse", "json_fields", "json_documents", "json_candidates", "route_by_size",
    "resolve_payloads", "resolve_hot", "retain_latest", "retain_latest_by_source", "pair_calls", "pair_calls_hot",
    "first_seen", "tuning_in_force", "record_decode", "tuning_long_log", "allowlist_intervals",
)


def hot_rate(spark, sf_dir):
    """A third of all rows on one key, which has no gap longer than a window."""
    packets = q.traffic(spark, sf_dir).select(
        "seq", "ts_ns", F.when(F.pmod("seq", F.lit(3)) == 0, 0).otherwise(F.col("src_ip")).alias("src_ip"), "dst_port"
    )
    return nl.rate_check(
        packets, ["src_ip"], "ts_ns", ["seq"], window_ns=3_600_000_000_000, threshold=2, hot_rows=5_000,
        chunk_rows=2_000,
    )


def flood_rate(spark, sf_dir):
    """All rows on one key, within a few windows."""
    packets = q.traffic(spark, sf_dir).select("seq", F.pmod("ts_ns", F.lit(100_000)).alias("ts_ns"), F.lit(1).alias("k"))
    return nl.rate_check(packets, ["k"], "ts_ns", ["seq"], window_ns=10_000, threshold=2, hot_rows=5_000, chunk_rows=2_000,
                         chunk_windows=1)


def burst_rate(spark, sf_dir):
    """All rows on one key, nearly all within one window: pieces shorter than it, and pointer doubling."""
    time_ns = F.when(F.pmod("seq", F.lit(100)) == 0, F.pmod("ts_ns", F.lit(10_000_000))).otherwise(F.pmod("ts_ns", F.lit(90_000)))
    packets = q.traffic(spark, sf_dir).select("seq", time_ns.alias("ts_ns"), F.lit(1).alias("k"))
    return nl.rate_check(packets, ["k"], "ts_ns", ["seq"], window_ns=100_000, threshold=2, hot_rows=5_000, chunk_rows=10_000,
                         burst_rows=20_000)


def resolve_share(every: int):
    """Documents as events of which one in ``every`` is a pointer."""
    def run(spark, sf_dir):
        docs = q.messages(spark, sf_dir)
        is_ref = F.pmod("seq", F.lit(every)) == 0
        events = docs.select(
            "seq", "ts_ns", is_ref.alias("is_ref"), F.when(is_ref, F.col("seq")).alias("payload_ref"),
            F.least(F.octet_length("payload"), F.lit(1024)).cast("bigint").alias("data_len"),
            F.when(~is_ref, F.substring("payload", 1, 1024)).alias("data"),
        )
        return nl.resolve_payloads(events, nl.message_payloads(nl.clamp_messages(docs)))

    return run


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="netlog-bench-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("netlog-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", f"{folder}/checkpoints")
    )
    spark = nl.configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # frames and records are made and stored before the clock starts, in as many parts as there are cores
    q.frames(spark, sf_dir).repartition(int(cpus)).write.parquet(f"{folder}/frames")
    q.records(spark, sf_dir).repartition(int(cpus)).write.parquet(f"{folder}/records")

    def decode_stored(spark, _):
        return nl.decode_frames(spark.read.parquet(f"{folder}/frames"))

    def records_stored(spark, _):
        return nl.decode_records(spark.read.parquet(f"{folder}/records"))

    runs = {name: q.QUERIES[name] for name in HEADLINE}
    runs |= {"decode_stored": decode_stored, "records_stored": records_stored, "flood_rate": flood_rate,
             "burst_rate": burst_rate}
    runs |= {"hot_rate": hot_rate, "resolve_1pct": resolve_share(100), "resolve_50pct": resolve_share(2)}
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    on_documents = {"json_documents", "route_by_size", "resolve_payloads", "resolve_1pct", "resolve_50pct"}
    seconds, rates = {}, {}
    for name, query in runs.items():
        for _ in range(2):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        rates[name] = round((n_docs if name in on_documents else n_events) / seconds[name])
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "rows_per_sec": rates, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
