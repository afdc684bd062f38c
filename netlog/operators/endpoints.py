"""Registry of local endpoints, and the messages that belong to a registered one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import PROTO_TCP

# The two connection events that register an endpoint.
ESTABLISHED_OPS = ("active_established", "passive_established")


def first_seen(conn_events: DataFrame) -> DataFrame:
    """The first established connection per local port: ``local_port, proto, conn_key, ts_ns, seq``.

    Counted down per task before the shuffle, so a hot port costs one row per task. At most 65,536 rows. The same
    aggregate runs on a stream in update mode.
    """
    return (
        conn_events.where(F.col("op").isin(*ESTABLISHED_OPS))
        .groupBy("local_port", F.lit(PROTO_TCP).alias("proto"))
        .agg(F.min_by(F.struct("conn_key", "ts_ns", "seq"), F.struct("ts_ns", "seq")).alias("_first"))
        .select("local_port", "proto", "_first.conn_key", "_first.ts_ns", "_first.seq")
    )


def registered_messages(messages: DataFrame, registry: DataFrame, *, per_connection: bool = False) -> DataFrame:
    """Messages on a registered ``(local_port, proto)``; with ``per_connection`` only those of the registered socket.

    The registry is reduced to one row per 16-bit port and 8-bit protocol before it is broadcast.
    """
    valid = registry.where(F.col("local_port").between(0, 65_535) & F.col("proto").between(0, 255))
    side = valid.groupBy("local_port", "proto").agg(F.min_by("conn_key", F.struct("ts_ns", "seq")).alias("conn_key"))
    names = ["local_port", "proto", "conn_key"] if per_connection else ["local_port", "proto"]
    return messages.join(F.broadcast(side.select(*names)), names, "left_semi")
