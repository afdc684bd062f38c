"""Lookups that classify flows: port interest list, address allowlist, and the two first-match verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.barrier import compute_once
from ..schemas import (
    INLINE_MAX, LOOPBACK_IP, PROTO_TCP, PROTO_UDP, RATE_THRESHOLD, RATE_WINDOW_NS, SSH_PORT,
)
from .asof import as_of
from .ratelimit import rate_check
from .sizes import BROADCAST_ROWS

# Keys that prefixes are expanded to, at most.
MAX_KEYS = 4_000_000
LAST_ADDRESS = 0xFFFFFFFF


def interest_set(interest: DataFrame) -> DataFrame:
    """Distinct valid ``(dst_port, proto)``. At most 65,536 ports x 2 protocols, so it is always safe to broadcast."""
    return (
        interest.where(F.col("port").between(0, 65_535) & F.col("proto").isin(PROTO_TCP, PROTO_UDP))
        .select(F.col("port").cast("int").alias("dst_port"), F.col("proto").cast("int").alias("proto"))
        .distinct()
    )


def interest_join(flows: DataFrame, interest: DataFrame) -> DataFrame:
    """Keep the flows whose ``(dst_port, proto)`` is of interest."""
    return flows.join(F.broadcast(interest_set(interest)), ["dst_port", "proto"], "left_semi")


def flag_interest(flows: DataFrame, interest: DataFrame, *, flag: str = "of_interest") -> DataFrame:
    """Add a boolean instead of filtering."""
    side = interest_set(interest).select(
        F.col("dst_port").alias("_port"), F.col("proto").alias("_proto"), F.lit(True).alias("_hit")
    )
    match = (flows["dst_port"] == side["_port"]) & (flows["proto"] == side["_proto"])
    joined = flows.join(F.broadcast(side), match, "left")
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_port", "_proto", "_hit")


def _prefixes(allowlist: DataFrame) -> DataFrame:
    return allowlist.where(f"plen BETWEEN 0 AND 32 AND net BETWEEN 0 AND {LAST_ADDRESS}")


def allowlist_rejects(allowlist: DataFrame) -> DataFrame:
    """The rows of ``allowlist`` that are no IPv4 prefix, with ``reject_reason``: ``bad_plen`` or ``bad_net``."""
    reason = (
        F.when(F.col("plen").isNull() | ~F.col("plen").between(0, 32), "bad_plen")
        .when(F.col("net").isNull() | ~F.col("net").between(0, LAST_ADDRESS), "bad_net")
    )
    return allowlist.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")


def prefix_intervals(allowlist: DataFrame) -> DataFrame:
    """(first, plen): disjoint intervals of addresses, from each ``first`` up to the next, with their longest prefix.

    Two prefixes are apart or one holds the other. So where a prefix begins, the longest that begins there counts; where
    one ends and none begins, the longest that holds the address does, which is looked up by equality for each
    length in use. NULL where no prefix holds. At most two rows per prefix; nothing is expanded or ordered in one task.
    """
    size = F.expr("shiftleft(1L, 32 - plen)")
    known = _prefixes(allowlist).select(
        F.col("plen").cast("int").alias("plen"), (F.col("net") - F.pmod("net", size)).cast("bigint").alias("first")).distinct()
    begins = known.groupBy("first").agg(F.max("plen").alias("plen"))
    ends = known.select((F.col("first") + size).alias("first")).where(F.col("first") <= LAST_ADDRESS).distinct()
    ends = ends.join(begins, "first", "left_anti")
    lengths = [r.plen for r in known.select("plen").distinct().collect()]
    asked = ends.select("first", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")).alias("plen"))
    asked = asked.withColumn("_held", F.col("first") - F.pmod("first", size))
    held = asked.join(known.withColumnRenamed("first", "_held"), ["plen", "_held"])
    longest = held.groupBy("first").agg(F.max("plen").alias("plen"))
    return begins.union(ends.join(longest, "first", "left").select("first", "plen"))


def flag_allowlist(
    flows: DataFrame, allowlist: DataFrame, *, ip: str = "src_ip", match: str = "allow_plen",
    max_broadcast: int = BROADCAST_ROWS, max_keys: int = MAX_KEYS,
) -> DataFrame:
    """Longest matching prefix length of ``allowlist(plen, net)``, NULL where none matches. One row in, one row out.

    Prefixes are expanded to the next length of 8, 16, 24 or 32 (at most 256 keys each), keeping the longest per key.
    Each length in use is then one equality join with unique keys, so nothing is exploded on the flow side. One small
    job first counts the keys of each length: up to ``max_broadcast`` they are broadcast, beyond that joined by
    shuffle, where adaptive skew handling splits a hot address. Beyond ``max_keys`` in all, nothing is expanded: the
    prefixes become disjoint intervals (``prefix_intervals``), each distinct address is looked up in them once by a merge
    of both in order, and one join brings the result to the flows. Rows of ``allowlist`` that are no prefix match nothing;
    ``allowlist_rejects`` tells them.
    """
    stride = F.expr("case when plen = 0 then 8 else cast(ceil(plen / 8) * 8 as int) end")
    # the range of keys starts on the prefix's own boundary even if the address has host bits set
    prefixes = (
        _prefixes(allowlist)
        .select(F.col("plen").cast("int").alias("plen"), F.col("net").cast("bigint").alias("net"))
        .withColumn("stride", stride)
        .withColumn("n_keys", F.expr("shiftleft(1L, stride - plen)"))
        .withColumn("first", F.expr("shiftright(net, 32 - stride) - pmod(shiftright(net, 32 - stride), n_keys)"))
    )
    in_use = {r.stride: r.total for r in prefixes.groupBy("stride").agg(F.sum("n_keys").alias("total")).collect()}
    if sum(in_use.values()) > max_keys:
        asked = flows.where(F.col(ip).isNotNull()).select(F.col(ip).alias("_address")).distinct()
        known = as_of(asked, prefix_intervals(allowlist), "_address", "first", out="_interval")
        known = known.select("_address", F.col("_interval.plen").alias("_found")).where("_found IS NOT NULL")
        met = flows.join(known, F.col(ip) == F.col("_address"), "left")
        return met.select(*[flows[c] for c in flows.columns], F.col("_found").alias(match))
    joined, found = flows, []
    for bits, total in sorted(in_use.items(), reverse=True):
        keys = (
            prefixes.where(F.col("stride") == bits)
            .select("plen", F.expr(f"explode(sequence(first, first + n_keys - 1)) as _key{bits}"))
            .groupBy(f"_key{bits}").agg(F.max("plen").alias(f"_plen{bits}"))
        )
        side = F.broadcast(keys) if total <= max_broadcast else keys
        joined = joined.join(side, F.expr(f"shiftright({ip}, {32 - bits}) = _key{bits}"), "left")
        found.append(F.col(f"_plen{bits}"))
    return joined.select(*flows.columns, F.coalesce(*found, F.lit(None).cast("int")).alias(match))


def allowlist_join(flows: DataFrame, allowlist: DataFrame, *, ip: str = "src_ip") -> DataFrame:
    """Keep the flows whose address is in the allowlist."""
    return flag_allowlist(flows, allowlist, ip=ip, match="_allowed").where("_allowed IS NOT NULL").drop("_allowed")


def _edge_reason(has_allowlist: bool) -> Column:
    """Reasons that need no rate state, first match wins; NULL for a flow that goes on to the rate check."""
    status, dport = F.col("decode_status"), F.col("dst_port")
    reason = (
        F.when(status.isin("short_eth", "short_vlan", "not_ipv4", "short_ip"), status)
        .when(F.col("src_ip") == LOOPBACK_IP, "bypass_loopback")
        .when(
            (F.col("proto") == PROTO_TCP) & ((dport == SSH_PORT) | (F.col("src_port") == SSH_PORT)), "bypass_ssh"
        )
    )
    if has_allowlist:
        reason = reason.when(F.col("_allowed").isNull(), "not_allowlisted")
    return (
        reason.when(status == "short_l4", "short_l4")
        .when((status != "ok") | (dport == 0), "pass")
        .when((dport != SSH_PORT) & ~F.col("_wanted"), "not_of_interest")
    )


def edge_verdict(
    flows: DataFrame, interest: DataFrame, allowlist: DataFrame | None, *, window_ns: int = RATE_WINDOW_NS,
    threshold: int | Column = RATE_THRESHOLD, check: Callable[..., DataFrame] = rate_check, **check_options,
) -> DataFrame:
    """Add ``edge_reason``, ``rate_window_start``, ``rate_count`` and ``rate_limited``. Nothing is dropped.

    The rate check counts only flows that reach it. ``allowlist=None`` skips the allowlist step; an empty allowlist
    sends every flow that gets there to ``not_allowlisted``. ``flows`` is read more than once, so give a table. On a
    stream, pass ``check=netlog.streaming.rate_stream``. ``check_options`` go to the check.
    """
    flagged = flag_interest(flows, interest, flag="_wanted")
    if allowlist is not None:
        flagged = flag_allowlist(flagged, allowlist, match="_allowed")
    reason = _edge_reason(allowlist is not None)
    decided = compute_once(flagged, {"edge_reason": reason}).select(*flows.columns, "edge_reason")

    settled = decided.where(F.col("edge_reason").isNotNull()).withColumns({
        "rate_window_start": F.lit(None).cast("bigint"),
        "rate_count": F.lit(None).cast("bigint"),
        "rate_limited": F.lit(False),
    })
    checked = check(
        decided.where(F.col("edge_reason").isNull()).drop("edge_reason"), ["src_ip", "dst_port"], "ts_ns", ["seq"],
        window_ns=window_ns, threshold=threshold, **check_options,
    ).select(
        *flows.columns, F.when(F.col("limited"), "rate_limited").otherwise("pass").alias("edge_reason"),
        F.col("window_start").alias("rate_window_start"), F.col("n").alias("rate_count"),
        F.col("limited").alias("rate_limited"),
    )
    return settled.unionByName(checked)


def capture_verdict(flows: DataFrame, interest: DataFrame, *, inline_max: int = INLINE_MAX) -> DataFrame:
    """Add ``capture_reason``, first match wins. No bypass and no allowlist apply on this path."""
    status = F.col("decode_status")
    reason = (
        F.when(status != "ok", status)
        .when(~F.col("_wanted"), "not_of_interest")
        .when(F.col("payload_len") <= 0, "empty_payload")
        .when(F.col("payload_len") > inline_max, "delegated_large")
        .otherwise("captured")
    )
    return flag_interest(flows, interest, flag="_wanted").withColumn("capture_reason", reason).drop("_wanted")
