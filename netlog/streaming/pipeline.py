"""Frames to JSON lines as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.barrier import compute_once
from ..operators import capture_inline, decode_frames, observe_rejects, parse_logs, resolve_payloads
from ..schemas import INTEREST, PAYLOADS
from ..session import configure
from ..sources import accepted_loads, append_interest, effective_interest, read_loads, write_logs
from .carry import last_carry, read_carry, write_carry


def stream_logs(
    frames: DataFrame, path: str, checkpoint: str, *, interest_table: str, interest_config: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Decode, capture, parse and write every micro-batch of ``frames`` to ``path/batch_id=N``.

    The interest list is read again for each micro-batch, from the table of loads; with ``interest_config`` the
    configuration files are first checked for new versions. A repeated micro-batch replaces its own folder, so each
    frame is written once. ``trigger`` goes to ``DataStreamWriter.trigger``.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = configure(batch.sparkSession)
        if interest_config is not None:
            interest = append_interest(spark, interest_config, interest_table)
        else:
            loads = read_loads(spark, interest_table)
            interest = (
                spark.createDataFrame([], INTEREST) if loads is None else effective_interest(accepted_loads(loads))
            )
        events = capture_inline(decode_frames(batch), interest)
        write_logs(observe_rejects(parse_logs(events), f"netlog_{batch_id}"), f"{path}/batch_id={batch_id}")

    return _start(frames, write_batch, checkpoint, trigger)


def stream_event_logs(
    events: DataFrame, path: str, checkpoint: str, *, payload_table: str | None = None, payloads: DataFrame | None = None,
    wait_ns: int | None = None, **trigger,
) -> StreamingQuery:
    """Resolve, parse and write a stream of capture events to ``path/batch_id=N``.

    Pointer events read the payload table as it then stands, and what came on ``payloads``, a stream (PAYLOADS) whose rows
    are kept in ``path/_payloads``. With ``wait_ns``, a pointer event whose payload is not there yet, or is shorter than
    it claims, waits in ``path/_waiting`` and is looked up again with each micro-batch, so events and payloads may come
    in any order. It is rejected once the clock is ``wait_ns`` past its time. The clock is the latest 99th percentile of
    a micro-batch's event and payload times, so one wrong reading rejects nothing. :func:`flush_event_logs` ends the wait
    for a stream that has stopped. Without ``wait_ns``, such an event is rejected at once.

    A micro-batch's own folders are replaced if it is repeated; what waits is a carry table (see ``carry``), written anew
    each time with what still waits.
    """
    stream = events.select(F.struct(*events.columns).alias("_event"))
    if payloads is not None:
        stored = F.struct(*[f.name for f in T.StructType.fromDDL(PAYLOADS)])
        stream = stream.unionByName(payloads.select(stored.alias("_payload")), allowMissingColumns=True)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = configure(batch.sparkSession)
        new = batch.where("_event IS NOT NULL").select("_event.*")
        if payloads is not None:
            came = batch.where("_payload IS NOT NULL").select("_payload.*")
            came.write.mode("overwrite").parquet(f"{path}/_payloads/batch_id={batch_id}")
        stored = _stored_payloads(spark, path, payload_table, payloads is not None)
        if wait_ns is None:
            found = resolve_payloads(new, stored)
        else:
            times = new.select("ts_ns") if payloads is None else new.select("ts_ns").union(came.select("ts_ns"))
            found = resolve_or_wait(new, stored, times, f"{path}/_waiting", batch_id, wait_ns=wait_ns)
        write_logs(observe_rejects(parse_logs(found), f"netlog_{batch_id}"), f"{path}/batch_id={batch_id}")

    return _start(stream, write_batch, checkpoint, trigger)


def resolve_or_wait(
    events: DataFrame, stored: DataFrame, times: DataFrame, path: str, batch_id: int, *, wait_ns: int,
) -> DataFrame:
    """``resolve_payloads`` for a micro-batch of ``events`` and those that waited: what is resolved or rejected now.

    What waits on is written to ``path``. ``times`` are the micro-batch's times (``ts_ns``), by which the clock goes on.
    """
    spark, columns = events.sparkSession, events.columns
    waiting = read_carry(spark, path, batch_id, _with_clock(events.schema))
    before = waiting.agg(F.max("_clock")).scalar()
    now = F.greatest(before, times.agg(F.percentile_approx("ts_ns", 0.99)).scalar())
    held = waiting.where("_waits").select(*columns).unionByName(events)
    found = resolve_payloads(held.withColumn("_as_it_was", F.struct(*columns)), stored)
    told = ("_as_it_was.is_ref AND _as_it_was.payload_ref IS NOT NULL AND reject_reason IN ('bad_ref', 'short_payload')"
            " AND _as_it_was.ts_ns IS NOT NULL")
    judged = found.withColumn("_clock", now).withColumn(
        "_waits", F.expr(f"coalesce({told} AND (_clock IS NULL OR _as_it_was.ts_ns + {wait_ns} >= _clock), false)"))
    judged = compute_once(judged, {"_waits": F.col("_waits")})
    still = judged.where("_waits").select("_as_it_was.*", "_waits", "_clock")
    # the clock is kept even when nothing waits
    clock = spark.range(1).select(F.lit(False).alias("_waits"), now.alias("_clock"))
    write_carry(still.unionByName(clock, allowMissingColumns=True), path, batch_id)
    return judged.where("NOT _waits").drop("_as_it_was", "_waits", "_clock")


def flush_event_logs(
    spark: SparkSession, path: str, schema: str | T.StructType, *, payload_table: str | None = None, payloads: bool = False,
) -> None:
    """End the wait of what :func:`stream_event_logs` left after its last micro-batch: resolved, or rejected for good.

    Written to ``path/batch_id=flush``; running it again replaces that. For a stream that is over: what waits is not taken
    from it. ``schema`` is that of its events; ``payloads`` says whether it had a stream of them.
    """
    columns = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    waiting = last_carry(configure(spark), f"{path}/_waiting", _with_clock(columns))
    held = waiting.where("_waits").select(*columns.fieldNames())
    logs = parse_logs(resolve_payloads(held, _stored_payloads(spark, path, payload_table, payloads)))
    write_logs(logs, f"{path}/batch_id=flush")


def _with_clock(columns: T.StructType) -> T.StructType:
    return T.StructType([*columns.fields]).add("_waits", T.BooleanType()).add("_clock", T.LongType())


def _stored_payloads(spark: SparkSession, path: str, payload_table: str | None, streamed: bool) -> DataFrame:
    stored = (
        spark.createDataFrame([], PAYLOADS) if payload_table is None else spark.read.schema(PAYLOADS).parquet(payload_table)
    )
    return stored.unionByName(spark.read.schema(PAYLOADS).parquet(f"{path}/_payloads/*")) if streamed else stored


def _start(stream: DataFrame, write_batch, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
