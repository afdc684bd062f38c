"""The whole dataflow as one batch job over captured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import operators as op
from ..schemas import PAYLOADS, RATE_THRESHOLD, RATE_WINDOW_NS
from ..session import configure
from ..sources import write_logs


def run_batch(
    spark: SparkSession, path: str, *, frames: DataFrame, interest: DataFrame, allowlist: DataFrame | None = None,
    messages: DataFrame | None = None, conn_events: DataFrame | None = None, probe_events: DataFrame | None = None,
    records: DataFrame | None = None, tuning: DataFrame | None = None,
    window_ns: int = RATE_WINDOW_NS, threshold: int = RATE_THRESHOLD,
) -> dict[str, DataFrame]:
    """Write ``flows``, ``verdicts``, ``payloads`` and ``logs`` under ``path``; return them and the counts as tables.

    Frames are read once: the flow table holds the header columns and the small payloads, and both the verdicts and
    the capture read that. Large messages of registered endpoints go to the payload table and are referred to by
    pointer events; paired calls give inline events; capture records are decoded as they are. Frames of over INLINE_MAX
    payload bytes become rejects that keep their bytes. All producers are merged, resolved, parsed and written. With
    ``tuning``, the rate threshold of each flow is the one in force at its time.
    """
    configure(spark)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    decoded = op.decode_frames(frames)
    flows = saved(op.with_payload(decoded), "flows")
    judged, limit = flows.drop("payload", "raw"), threshold
    if tuning is not None:
        judged, limit = op.tuning_in_force(judged, tuning), F.col("max_rate_pps")
    verdicts = saved(op.edge_verdict(judged, interest, allowlist, window_ns=window_ns, threshold=limit), "verdicts")
    sources = {"tc": op.capture_inline(flows, interest), "tc_large": op.delegated_large(decoded, interest)}
    if records is not None:
        sources["records"] = op.decode_records(records)
    payloads = spark.createDataFrame([], PAYLOADS)
    if messages is not None and conn_events is not None:
        kept = op.clamp_messages(op.registered_messages(messages, op.first_seen(conn_events)))
        payloads = saved(op.message_payloads(kept), "payloads")
        sources["sk_msg"] = op.message_events(kept.drop("payload"))
    if probe_events is not None:
        sources["tls"] = op.pair_calls(probe_events).select("seq", "ts_ns", "pid", "tid", "data_len", "data")
    # events are judged by their lengths and references even where nothing is stored
    events = op.resolve_payloads(op.merge_sources(**sources), payloads)
    logs = saved(op.parse_logs(events).withColumn("doc", F.to_json("doc")), "parsed")
    logs = logs.withColumn("doc", F.try_parse_json("doc"))
    write_logs(logs, f"{path}/logs")
    return {
        "flows": flows, "verdicts": verdicts, "logs": spark.read.text(f"{path}/logs"),
        "edge_counts": op.reason_counts(verdicts, "edge_reason"), "drop_total": op.drop_total(verdicts),
        "capture_counts": op.reason_counts(op.capture_verdict(flows, interest), "capture_reason"),
        "stage_counts": op.stage_counts(logs),
    }
