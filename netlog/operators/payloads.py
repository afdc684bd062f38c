"""Payload extraction, size routing, stored payloads and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.barrier import compute_once
from ..functions.bits import clamp, le_words
from ..schemas import INLINE_MAX, MAX_JSON_BYTES, RECORD_BYTES
from .bitfilter import bit_filter, with_filter
from .policy import interest_join
from .sizes import BROADCAST_ROWS
from .skew import same_key

# Events that point to one stored payload before it counts as hot, and the events wanted in each part of a hot one.
HOT_ROWS = 1_000_000
PART_ROWS = 500_000


def size_route(payload_len: Column, *, inline_max: int = INLINE_MAX) -> Column:
    """``inline`` up to and including ``inline_max`` bytes, ``large`` above, NULL without a payload."""
    return F.when(payload_len <= 0, F.lit(None)).when(payload_len <= inline_max, "inline").otherwise("large")


def with_payload(flows: DataFrame, *, frame: str = "frame", inline_max: int = INLINE_MAX) -> DataFrame:
    """Replace the frame by ``payload``, its 1 to ``inline_max`` payload bytes, NULL if the frame has fewer, and then
    ``raw``, the bytes that are there.

    The result is a table to keep: verdicts read its narrow columns, capture its ``payload``, neither the frames.
    """
    there = F.col("payload_len").between(1, inline_max) & (
        F.octet_length(frame) >= F.col("payload_off") + F.col("payload_len")
    )
    data = F.substring(F.col(frame), F.col("payload_off") + 1, F.col("payload_len"))
    short = F.col("payload_len").between(1, inline_max) & ~there
    return flows.withColumns({"payload": F.when(there, data), "raw": F.when(short, data)}).drop(frame)


def capture_inline(
    flows: DataFrame, interest: DataFrame, *, inline_max: int = INLINE_MAX, keep: Sequence[str] = ()
) -> DataFrame:
    """Capture events of the decodable flows of interest that carry 1 to ``inline_max`` payload bytes.

    ``flows`` has ``frame`` or, from ``with_payload``, ``payload``; ``keep`` names flow columns to carry along. A
    frame shorter than its header claims is kept with ``reject_reason`` ``short_payload``, no data, and its bytes in ``raw``.
    """
    if "payload" not in flows.columns:
        flows = with_payload(flows, inline_max=inline_max)
    wanted = interest_join(
        flows.where((F.col("decode_status") == "ok") & F.col("payload_len").between(1, inline_max)), interest
    )
    return wanted.select(
        "seq", "ts_ns", *keep, F.lit(False).alias("is_ref"), F.col("payload_len").cast("bigint").alias("data_len"),
        F.col("payload").alias("data"), F.when(F.col("payload").isNull(), "short_payload").alias("reject_reason"), "raw",
    )


def clamp_messages(messages: DataFrame, *, payload: str = "payload", slot_bytes: int | None = None) -> DataFrame:
    """Drop empty messages and add ``size``. Messages stay whole unless ``slot_bytes`` asks for a cut.

    With ``slot_bytes`` (SLOT_BYTES in the capture's own store), only so many bytes of a message are kept, and
    ``original_size`` and ``truncated`` tell of it.
    """
    full = messages.where(F.octet_length(payload) > 0)
    size = F.octet_length(payload).cast("bigint")
    if slot_bytes is None:
        return full.withColumn("size", size)
    return full.withColumns({
        "size": clamp(F.octet_length(payload), slot_bytes).cast("bigint"), "original_size": size,
        "truncated": size > slot_bytes, payload: F.substring(payload, 1, slot_bytes),
    })


def delegated_large(flows: DataFrame, interest: DataFrame, *, inline_max: int = INLINE_MAX) -> DataFrame:
    """Rejects for decodable flows of interest with over ``inline_max`` payload bytes, which no inline event carries.

    ``flows`` has ``frame``; its payload bytes are kept in ``raw``, so that a large frame is neither lost nor uncounted.
    """
    large = interest_join(flows.where((F.col("decode_status") == "ok") & (F.col("payload_len") > inline_max)), interest)
    raw = F.substring(F.col("frame"), F.col("payload_off") + 1, F.col("payload_len"))
    return large.select(
        "seq", "ts_ns", F.lit(False).alias("is_ref"), F.col("payload_len").cast("bigint").alias("data_len"),
        F.lit(None).cast("binary").alias("data"), raw.alias("raw"), F.lit("delegated_large").alias("reject_reason"),
    )


def message_events(clamped: DataFrame) -> DataFrame:
    """Pointer events of clamped messages; the message's ``seq`` is its payload reference."""
    return clamped.select(
        "seq", "ts_ns", F.lit(True).alias("is_ref"), F.col("seq").alias("payload_ref"), F.col("size").alias("data_len")
    )


def message_payloads(clamped: DataFrame) -> DataFrame:
    """The payload table the pointer events refer to."""
    return clamped.select(F.col("seq").alias("payload_ref"), "ts_ns", "seq", "payload")


def merge_sources(**sources: DataFrame) -> DataFrame:
    """One event table from several producers, named by ``source``. Nothing is deduplicated."""
    merged = None
    for name, events in sources.items():
        part = events.withColumn("source", F.lit(name))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged


def decode_records(records: DataFrame, *, record: str = "record") -> DataFrame:
    """Fixed-layout little-endian capture records to capture-event columns.

    Layout: conn_id u32@0, pid u32@4, tid u32@8, ts_ns u64@16, is_ref u8@24, payload_ref u32@28, data_len u32@32,
    data@36. A record under 1,064 bytes gets ``reject_reason`` ``short_record``, no fields, and its bytes in ``raw``.
    """
    others = [c for c in records.columns if c != record]
    whole = F.octet_length(record) >= RECORD_BYTES
    readable = records.select(*others, record, F.coalesce(whole, F.lit(False)).alias("_whole"))
    words = le_words(readable, record, {"_w0": 0, "_w8": 8, "_w16": 16, "_w24": 24, "_w32": 32})
    low = 0xFFFFFFFF
    fields = words.withColumns({
        "_is_ref": F.expr("(_w24 & 255) = 1"),
        "_data_len": F.expr(f"_w32 & {low}"),
    })
    made = {
        "conn_id": f"_w0 & {low}",
        "pid": "shiftrightunsigned(_w0, 32)",
        "tid": f"_w8 & {low}",
        "ts_ns": "if(_w16 >= 0, _w16, null)",
        "is_ref": "_is_ref",
        "payload_ref": "if(_is_ref, shiftrightunsigned(_w24, 32), null)",
        "data_len": "_data_len",
        "data": f"if(_is_ref, null, substring({record}, 37, cast(least(_data_len, {INLINE_MAX}) as int)))",
    }
    once = compute_once(fields, {
        **{name: F.when(F.col("_whole"), F.expr(text)) for name, text in made.items()},
        "reject_reason": F.when(~F.col("_whole"), "short_record"),
        "raw": F.when(~F.col("_whole"), F.col(record)),
    })
    return once.select(*others, *made, "reject_reason", "raw")


def record_reject(*, inline_max: int = INLINE_MAX, max_bytes: int = MAX_JSON_BYTES, max_ref: int | None = None):
    """First-match reason an event cannot be read, before its payload is looked up; NULL when it can."""
    is_ref = F.coalesce("is_ref", F.lit(False))
    reason = (
        F.when(F.col("data_len").isNull(), "short_record")
        .when(F.col("data_len") <= 0, "empty")
        .when(F.col("data_len") > max_bytes, "too_large")
        .when(is_ref & F.col("payload_ref").isNull(), "bad_ref")
    )
    if max_ref is not None:
        reason = reason.when(is_ref & (F.col("payload_ref") + F.col("data_len") > max_ref), "bad_ref")
    return reason.when(~is_ref & (F.col("data_len") > inline_max), "bad_inline_len")


def resolve_payloads(
    events: DataFrame, payloads: DataFrame, *, inline_max: int = INLINE_MAX, max_bytes: int = MAX_JSON_BYTES,
    max_ref: int | None = None, hot_rows: int | None = HOT_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Replace ``data`` by the event's bytes: stored ones for pointer events, its own for the others.

    Adds or fills ``reject_reason``; a rejected event has no data, what bytes it came with are in ``raw``. If ``payloads``
    has several rows of one ``payload_ref``, the latest by ``ts_ns`` and ``seq`` counts, as in a slot that is written again.

    Only readable pointer events are joined, so inline and rejected events are not shuffled. Of the stored payloads,
    references and times are reduced to the wanted references' latest first; a filter of fixed size then tells the scan of
    the bytes which rows those are, and only they are shuffled. A reference that more than ``hot_rows`` events point to is spread over parts of about
    ``part_rows`` events, its payload row being repeated in each. The list of such references has at most one row for
    each ``hot_rows`` events, which bounds its broadcast.
    """
    if "payload_ref" not in events.columns:  # events without any reference
        events = events.withColumn("payload_ref", F.lit(None).cast("bigint"))
    prior = F.col("reject_reason") if "reject_reason" in events.columns else F.lit(None).cast("string")
    reason = F.coalesce(prior, record_reject(inline_max=inline_max, max_bytes=max_bytes, max_ref=max_ref))
    raw = F.col("raw") if "raw" in events.columns else F.lit(None).cast("binary")
    judged = events.withColumn("reject_reason", reason)
    judged = judged.withColumn("raw", F.when(F.col("reject_reason").isNotNull(), F.coalesce(raw, F.col("data").cast("binary"))))
    columns = judged.columns
    points = F.coalesce("is_ref", F.lit(False)) & F.col("reject_reason").isNull()

    own = judged.where(~points)
    own = own.withColumn("data", F.when(F.col("reject_reason").isNull(), F.substring(F.col("data"), F.lit(1), _length())))

    pointers = judged.where(points)
    stored = _latest_stored(payloads, pointers.select(F.col("payload_ref").alias("_ref")).distinct())
    if hot_rows is None:
        joined = pointers.join(stored, F.col("payload_ref") == F.col("_ref"), "left")
    else:
        hot = F.broadcast(
            pointers.groupBy("payload_ref").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > hot_rows)
            .select(F.col("payload_ref").alias("_hot_ref"), F.ceil(F.col("_n") / part_rows).alias("_parts"))
        )
        part = F.when(F.col("_hot_ref").isNull(), 0).otherwise(F.pmod(F.xxhash64("seq", "ts_ns"), "_parts"))
        salted = (
            pointers.join(hot, F.col("payload_ref") == F.col("_hot_ref"), "left")
            .withColumn("_part", part.cast("int")).drop("_hot_ref", "_parts")
        )
        last = F.when(F.col("_hot_ref").isNull(), 0).otherwise(F.col("_parts") - 1).cast("int")
        spread = (
            stored.join(hot, F.col("_ref") == F.col("_hot_ref"), "left")
            .select("_ref", "_stored", F.explode(F.sequence(F.lit(0), last)).alias("_stored_part"))
        )
        # sizes are estimated before rows are repeated, so a broadcast of this side could be far larger than planned
        joined = salted.join(
            spread.hint("merge"), (F.col("payload_ref") == F.col("_ref")) & (F.col("_part") == F.col("_stored_part")), "left"
        )
    resolved = joined.withColumns({
        "reject_reason": F.when(F.col("_ref").isNull() | F.col("_stored").isNull(), "bad_ref")
        .when(F.octet_length("_stored") < F.col("data_len"), "short_payload"),
    }).withColumn(
        "data", F.when(F.col("reject_reason").isNull(), F.substring(F.col("_stored"), F.lit(1), _length()))
    )
    return own.select(*columns).unionByName(resolved.select(*columns))


def _latest_stored(payloads: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_ref, _stored) of the ``wanted`` references: the latest payload, if times are known, else the largest of them."""
    order = [c for c in ("ts_ns", "seq") if c in payloads.columns]
    ref = F.col("payload_ref").alias("_ref")
    known = payloads.select(ref, *order).join(wanted, "_ref", "left_semi")
    if order:
        known = known.groupBy("_ref").agg(F.max(F.struct(*order)).alias("_last")).select("_ref", "_last.*")
    marks = bit_filter(known.select(F.xxhash64("_ref", *order).alias("_mark")), "_mark")
    marked = payloads.select(ref, *order, "payload").withColumn("_mark", F.xxhash64("_ref", *order))
    chosen = with_filter(marked, "_mark", marks, "_chosen").where("_chosen")
    # rows that the filter lets through by chance are no later than the one that is looked for
    picked = F.max_by("payload", F.struct(*order)) if order else F.max("payload")
    return chosen.groupBy("_ref").agg(picked.alias("_stored"))


def _length() -> Column:
    return F.col("data_len").cast("int")


def retain_latest(
    df: DataFrame, n: int, *, by: Sequence[str] = (), order: Sequence[str] = ("ts_ns", "seq")
) -> DataFrame:
    """The latest ``n`` rows, in all or per ``by`` key. Each task keeps at most ``n`` keys (rows per key) before a merge.

    Over all, the ``order`` columns alone are ranked; whole rows are fetched afterwards, only those that made it.
    """
    latest = [F.desc(c) for c in order]
    if not by:
        ranked = df.select(*order).orderBy(*latest).limit(n).distinct()
        if n <= BROADCAST_ROWS:
            ranked = F.broadcast(ranked)
        kept = df.join(ranked.withColumnsRenamed({c: f"_top_{c}" for c in order}), same_key(order, "_top_"), "left_semi")
        return kept.orderBy(*latest).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*latest))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
