"""The whole dataflow as one stream job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import operators as op
from ..schemas import CONN_EVENTS, INTEREST, PAYLOADS, RATE_THRESHOLD, RATE_WINDOW_NS
from ..session import configure
from ..sources import accepted_loads, append_interest, effective_interest, read_loads, write_logs
from .carry import read_carry, write_carry
from .pipeline import resolve_or_wait

RATE_KEYS = ["src_ip", "dst_port"]
THREAD_KEYS = ["pid", "tid"]


def run_stream(
    path: str, checkpoint: str, *, interest_table: str, frames: DataFrame, interest_config: str | None = None,
    allowlist: DataFrame | None = None, messages: DataFrame | None = None, conn_events: DataFrame | None = None,
    probe_events: DataFrame | None = None, records: DataFrame | None = None, tuning: Callable[[SparkSession], DataFrame] | None = None,
    window_ns: int = RATE_WINDOW_NS, threshold: int = RATE_THRESHOLD, wait_ns: int | None = None, **trigger,
) -> StreamingQuery:
    """``run_batch`` as a stream: the sources are streams, and one query takes them all, micro-batch by micro-batch.

    Under ``path``, each in ``batch_id=N`` of its own: ``flows``, ``verdicts``, ``payloads``, ``logs`` and ``counts``. A
    repeated micro-batch replaces its folders. What goes on from one to the next is kept in carry tables under
    ``path/state``: the window of each rate key, stored buffers of open calls, the first connection of each endpoint and,
    with ``wait_ns``, pointer events whose payload has not come. So a restarted query goes on where it stopped.

    The interest list is read again for each micro-batch, after new configuration files if ``interest_config`` is given;
    ``tuning`` is called for the records as they stand. Results equal those of the batch job for sources that come in order
    of time. A message whose endpoint has not been seen yet is not captured. ``trigger`` goes to ``DataStreamWriter.trigger``.
    """
    sources = {"frames": frames, "messages": messages, "conn_events": conn_events, "probe_events": probe_events, "records": records}
    sources = {name: df for name, df in sources.items() if df is not None}
    packed = [df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"_{name}")) for name, df in sources.items()]
    stream = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = configure(batch.sparkSession)
        part = {name: batch.where(f"_{name} IS NOT NULL").select(f"_{name}.*") for name in sources}

        def saved(df: DataFrame, name: str) -> DataFrame:
            folder = f"{path}/{name}/batch_id={batch_id}"
            df.write.mode("overwrite").parquet(folder)
            return spark.read.schema(df.schema).parquet(folder)

        def carried(name: str, schema: str | T.StructType) -> DataFrame:
            schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return read_carry(spark, f"{path}/state/{name}", batch_id, schema)

        def carry(df: DataFrame, name: str) -> None:
            write_carry(df, f"{path}/state/{name}", batch_id)

        interest = _interest(spark, interest_table, interest_config)
        decoded = op.decode_frames(part["frames"])
        flows = saved(op.with_payload(decoded), "flows")
        judged, limit = flows.drop("payload", "raw"), threshold
        if tuning is not None:
            judged, limit = op.tuning_in_force(judged, tuning(spark)), F.col("max_rate_pps")
        windows = carried("windows", "src_ip BIGINT, dst_port INT, window_start BIGINT, n BIGINT")
        verdicts = saved(op.edge_verdict(judged, interest, allowlist, window_ns=window_ns, threshold=limit, opened=windows), "verdicts")
        checked = verdicts.where("rate_window_start IS NOT NULL").select(
            *RATE_KEYS, F.col("rate_window_start").alias("window_start"), F.col("rate_count").alias("n"))
        carry(op.open_windows(checked, RATE_KEYS, opened=windows), "windows")

        made = {"tc": op.capture_inline(flows, interest), "tc_large": op.delegated_large(decoded, interest)}
        if "records" in part:
            made["records"] = op.decode_records(part["records"])
        payloads = spark.createDataFrame([], PAYLOADS)
        if "messages" in part and "conn_events" in part:
            seen = carried("endpoints", CONN_EVENTS)
            endpoints = op.first_seen(part["conn_events"].select(seen.columns).unionByName(seen))
            carry(endpoints.select("seq", "ts_ns", F.lit("active_established").alias("op"), "local_port", "conn_key"), "endpoints")
            kept = op.clamp_messages(op.registered_messages(part["messages"], endpoints))
            saved(op.message_payloads(kept), "payloads")
            payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads/*")
            made["sk_msg"] = op.message_events(kept.drop("payload"))
        if "probe_events" in part:
            calls = part["probe_events"]
            opened = carried("calls", T.StructType(
                [*[calls.schema[k] for k in THREAD_KEYS], calls.schema["buf"], T.StructField("enter_ns", calls.schema["ts_ns"].dataType)]))
            made["tls"] = op.pair_calls(calls, opened=opened).select("seq", "ts_ns", "pid", "tid", "data_len", "data")
            carry(op.open_calls(calls, opened=opened), "calls")

        events = op.merge_sources(**made)
        if wait_ns is None:
            found = op.resolve_payloads(events, payloads)
        else:
            times = reduce(DataFrame.union, [df.select("ts_ns") for df in part.values() if "ts_ns" in df.columns])
            found = resolve_or_wait(events, payloads, times, f"{path}/state/waiting", batch_id, wait_ns=wait_ns)
        logs = op.parse_logs(found).withColumn("doc", F.to_json("doc"))
        folder = f"{path}/parsed/batch_id={batch_id}"
        logs.write.mode("overwrite").parquet(folder)
        logs = spark.read.schema(logs.schema).parquet(folder)
        write_logs(logs.withColumn("doc", F.try_parse_json("doc")), f"{path}/logs/batch_id={batch_id}")

        stages = op.stage_counts(logs)
        counts = [
            op.reason_counts(verdicts, "edge_reason").select(F.lit("edge").alias("kind"), F.col("edge_reason").alias("reason"), "rows"),
            op.reason_counts(op.capture_verdict(flows, interest), "capture_reason").select(F.lit("capture"), "capture_reason", "rows"),
            stages.select(F.lit("stage"), F.inline(F.array(*[
                F.struct(F.lit(c).alias("reason"), F.col(c).alias("rows")) for c in stages.columns]))),
        ]
        saved(reduce(DataFrame.union, counts), "counts")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, reason, rows) over all micro-batches of :func:`run_stream`: ``edge``, ``capture`` and ``stage`` counts."""
    return spark.read.parquet(f"{path}/counts").groupBy("kind", "reason").agg(F.sum("rows").alias("rows"))


def _interest(spark: SparkSession, table: str, config: str | None) -> DataFrame:
    if config is not None:
        return append_interest(spark, config, table)
    loads = read_loads(spark, table)
    return spark.createDataFrame([], INTEREST) if loads is None else effective_interest(accepted_loads(loads))
