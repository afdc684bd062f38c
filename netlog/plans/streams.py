"""Queries that run as streams: the driver's rows in parts of ascending time, one micro-batch each, then the results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import CAPTURE_EVENTS
from ..session import configure, ensure_checkpoint_dir
from ..sources import normalize_interest, read_table_stream
from ..streaming import (
    flush_event_logs, pair_calls_batches, rate_batches, retain_batches, retained, run_stream, stream_counts, stream_event_logs,
)
from .queries import (
    INTEREST_ROWS, RATE_LIMIT, RATE_WINDOW, _pairs, allowlist, frames, messages, probe_events, traffic,
)

PARTS = 3
NOW = {"availableNow": True}
# One micro-batch takes all files of a part, however many tasks wrote it.
ALL_FILES = 2**31 - 1


def folder(spark: SparkSession, name: str) -> str:
    """A new folder among the session's shared ones."""
    shared = ensure_checkpoint_dir(configure(spark), "spark-warehouse/checkpoints")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_order(df: DataFrame, ts: str = "ts_ns") -> list[DataFrame]:
    """``df`` in PARTS parts, each of later times than the one before."""
    cuts = df.approxQuantile(ts, [i / PARTS for i in range(1, PARTS)], 0.01) if PARTS > 1 else []
    if not cuts:  # one part, or no time at all
        return [df, *[df.where(F.lit(False))] * (PARTS - 1)]
    bounds, parts = [None, *cuts, None], []
    for low, high in zip(bounds, bounds[1:]):
        later = F.lit(True) if low is None else F.col(ts) > low
        sooner = F.lit(True) if high is None else F.col(ts) <= high
        parts.append(df.where(later & sooner))
    return parts


def run_in_order(start: Callable[..., StreamingQuery], path: str, **sources: DataFrame) -> None:
    """Run the query that ``start`` makes of the ``sources`` as streams, one micro-batch for each part of ascending time.

    A part is written by as many tasks as read the source. Then the query is started: it goes on from its checkpoint,
    takes all files that came, as one micro-batch, and stops.
    """
    parts = {name: in_order(df) for name, df in sources.items()}
    for i in range(PARTS):
        streams = {}
        for name, df in sources.items():
            parts[name][i].write.mode("append").parquet(f"{path}/{name}")
            streams[name] = read_table_stream(df.sparkSession, f"{path}/{name}", df.schema, max_files=ALL_FILES)
        finished(start(**streams))


def finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "stream-rate")
    rows = traffic(spark, sf_dir).select("seq", "ts_ns", "src_ip", "dst_port")
    run_in_order(lambda packets: rate_batches(
        packets, f"{out}/out", f"{out}/ckpt", ["src_ip", "dst_port"], "ts_ns", ["seq"],
        window_ns=RATE_WINDOW, threshold=RATE_LIMIT, trigger=NOW), f"{out}/in", packets=rows)
    return spark.read.parquet(f"{out}/out/rows").drop("batch_id", "late")


def stream_pair_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "stream-calls")
    run_in_order(lambda calls: pair_calls_batches(calls, f"{out}/out", f"{out}/ckpt", trigger=NOW),
                 f"{out}/in", calls=probe_events(spark, sf_dir))
    return _pairs(spark.read.parquet(f"{out}/out/pairs"))


def stream_retain_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "stream-latest")
    run_in_order(lambda packets: retain_batches(packets, f"{out}/out", f"{out}/ckpt", 3, by=["src_ip"], trigger=NOW),
                 f"{out}/in", packets=traffic(spark, sf_dir).select("seq", "ts_ns", "src_ip"))
    return retained(spark, f"{out}/out").select("src_ip", "seq", "ts_ns")


def stream_waiting_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is stored as JSON, every ninth not, and pointed to by an event that comes long before its payload."""
    out = folder(spark, "stream-pointers")
    docs = messages(spark, sf_dir)
    json = F.to_json(F.struct(F.col("payload").cast("string").alias("text"))).cast("binary")
    stored = docs.select(F.col("seq").alias("payload_ref"), (F.col("ts_ns") + 10**12).alias("ts_ns"), "seq", json.alias("payload"))
    empty = spark.createDataFrame([], CAPTURE_EVENTS)
    events = empty.unionByName(stored.select(
        "seq", F.lit("sk_msg").alias("source"), (F.col("ts_ns") - 10**12).alias("ts_ns"), F.lit(True).alias("is_ref"), "payload_ref",
        F.octet_length("payload").cast("bigint").alias("data_len")), allowMissingColumns=True)
    payloads = stored.where("payload_ref % 9 <> 0").select("payload_ref", "ts_ns", "seq", "payload")
    run_in_order(lambda events, payloads: stream_event_logs(
        events, f"{out}/out", f"{out}/ckpt", payloads=payloads, wait_ns=2 * 10**12, **NOW),
        f"{out}/in", events=events, payloads=payloads)
    flush_event_logs(spark, f"{out}/out", events.schema, payloads=True)
    lines = spark.read.text(f"{out}/out")
    rejected = F.from_json("value", "seq BIGINT, reject_reason STRING")
    logs = F.from_json("value", "text STRING")
    return lines.select(
        "channel", F.md5(logs["text"]).alias("digest"), rejected["seq"].alias("seq"), rejected["reject_reason"].alias("reject_reason"))


def stream_edge_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of the whole dataflow as a stream."""
    out = _dataflow(spark, sf_dir)
    return spark.read.parquet(f"{out}/verdicts").select("seq", "edge_reason", "rate_window_start", "rate_count", "rate_limited")


def stream_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_counts(spark, _dataflow(spark, sf_dir)).where("kind = 'edge'").select(F.col("reason").alias("edge_reason"), "rows")


def _dataflow(spark: SparkSession, sf_dir: str) -> str:
    out = folder(spark, "stream-dataflow")
    names = {6: "tcp", 17: "udp"}
    listed = spark.createDataFrame(
        [("load", port, names[proto]) for port, proto, _ in INTEREST_ROWS], "load_id STRING, port BIGINT, protocol STRING")
    loads = normalize_interest(listed.withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")))
    loads.select("load_id", "loaded_at", "port", "protocol", "proto", "reject_reason").write.parquet(f"{out}/loads")
    run_in_order(lambda frames, calls: run_stream(
        f"{out}/out", f"{out}/ckpt", interest_table=f"{out}/loads", frames=frames, probe_events=calls, allowlist=allowlist(spark),
        window_ns=RATE_WINDOW, threshold=RATE_LIMIT, **NOW), f"{out}/in", frames=frames(spark, sf_dir), calls=probe_events(spark, sf_dir))
    return f"{out}/out"


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stream_rate_check, stream_pair_calls, stream_retain_latest, stream_waiting_pointers, stream_edge_verdict, stream_edge_counts,
    )
}
