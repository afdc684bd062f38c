"""The same answers as SQL over the tables, taken from the columns and not through frames, joins or scans."""

from __future__ import annotations

# One packet per event.
TRAFFIC = """
traffic AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id + 167772160 AS src_ip,
    CAST(167837697 AS BIGINT) AS dst_ip, CAST(40000 + event_id % 20000 AS INT) AS src_port,
    CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 8080 WHEN 'error' THEN 514 WHEN 'signup' THEN 53
      ELSE 22 END AS INT) AS dst_port,
    CAST(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 6 ELSE 17 END AS INT) AS proto,
    CAST(event_id % 3 AS INT) AS n_vlan, props AS payload
  FROM events
)"""

# Network address and size of each allowed prefix: 10.0.0.0/26, 10.0.0.16/28, 10.0.0.128/25.
ALLOW = """
allow(plen, low, size) AS (VALUES (26, 167772160, 64), (28, 167772176, 16), (25, 167772288, 128))"""

TUNING = """
tuning(effective_ns, version, max_rate_pps, sampling_num, sampling_den) AS (
  VALUES (CAST(1704844800000000000 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(2 AS BIGINT)),
    (1705708800000000000, 3, 1, 2, 3)
), intervals AS (
  SELECT *, lead(effective_ns) OVER (ORDER BY effective_ns) AS until_ns FROM tuning
), tuned AS (
  SELECT t.seq, t.ts_ns, t.src_ip, t.dst_port, coalesce(i.version, 1) AS version,
    coalesce(i.max_rate_pps, 1000) AS max_rate_pps, coalesce(i.sampling_num, 1) AS sampling_num,
    coalesce(i.sampling_den, 1) AS sampling_den
  FROM traffic t LEFT JOIN intervals i
    ON t.ts_ns >= i.effective_ns AND (i.until_ns IS NULL OR t.ts_ns < i.until_ns)
)"""


def windows(source: str, key: str, window_ns: int) -> str:
    """Anchored windows of ``source(seq, ts_ns, key)``: recursion over window starts, then places within a window."""
    return f"""
starts AS (
  SELECT {key}, min(ts_ns) AS window_start FROM {source} GROUP BY {key}
  UNION ALL
  SELECT {key}, window_start FROM (
    SELECT s.{key.replace(", ", ", s.")}, (
      SELECT min(r.ts_ns) FROM {source} r
      WHERE {" AND ".join(f"r.{k} = s.{k}" for k in key.split(", "))} AND r.ts_ns > s.window_start + {window_ns}
    ) AS window_start FROM starts s
  ) WHERE window_start IS NOT NULL
), counted AS (
  SELECT r.*, s.window_start,
    row_number() OVER (PARTITION BY {", ".join(f"r.{k}" for k in key.split(", "))}, s.window_start
      ORDER BY r.ts_ns, r.seq) AS n
  FROM {source} r ASOF JOIN starts s
    ON {" AND ".join(f"r.{k} = s.{k}" for k in key.split(", "))} AND r.ts_ns >= s.window_start
)"""


THREE_DAYS = 259_200_000_000_000
HOUR = 3_600_000_000_000

EDGE = f"""WITH RECURSIVE {TRAFFIC}, {ALLOW}, flagged AS (
  SELECT t.*, EXISTS (SELECT 1 FROM allow a WHERE t.src_ip >= a.low AND t.src_ip < a.low + a.size) AS allowed
  FROM traffic t
), decided AS (
  SELECT *, CASE WHEN src_ip = 2130706433 THEN 'bypass_loopback'
    WHEN proto = 6 AND (dst_port = 22 OR src_port = 22) THEN 'bypass_ssh'
    WHEN NOT allowed THEN 'not_allowlisted'
    WHEN dst_port = 0 THEN 'pass'
    WHEN dst_port <> 22 AND (dst_port, proto) NOT IN ((443, 6), (8080, 6), (514, 17)) THEN 'not_of_interest'
    END AS reason
  FROM flagged
), reaching AS (SELECT * FROM decided WHERE reason IS NULL),
{windows("reaching", "src_ip, dst_port", THREE_DAYS)}, verdicts AS (
  SELECT seq, reason AS edge_reason, CAST(NULL AS BIGINT) AS rate_window_start, CAST(NULL AS BIGINT) AS rate_count,
    false AS rate_limited FROM decided WHERE reason IS NOT NULL
  UNION ALL
  SELECT seq, CASE WHEN n > 1 THEN 'rate_limited' ELSE 'pass' END, window_start, n, n > 1 FROM counted
)"""

DAMAGED = """
damaged AS (
  SELECT event_id, CASE event_id % 68 WHEN 0 THEN left(props, length(props) - 1) WHEN 17 THEN props || '] x'
    WHEN 34 THEN '[' || props || ']' WHEN 51 THEN '' ELSE props END AS data FROM events
), judged AS (
  SELECT event_id, CASE WHEN strlen(data) = 0 THEN 'empty' WHEN NOT json_valid(data) THEN 'bad_json'
    WHEN json_type(data) <> 'OBJECT' THEN 'bad_json' END AS reject_reason FROM damaged
)"""

PAIRS = """
calls AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, {pid} AS pid, {tid} AS tid, event_type = 'click' AS enters,
    event_id * 16 AS buf, floor(value * 100) - 1000 AS ret, props AS data
  FROM events WHERE event_type IN ('click', 'view')
), seen AS (
  SELECT *, last_value(CASE WHEN enters OR ret > 0 THEN struct_pack(stored := enters, buf := buf, at := ts_ns) END
    IGNORE NULLS) OVER (PARTITION BY pid, tid ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM (SELECT seq, ts_ns, pid, tid, enters, buf, CASE WHEN enters THEN NULL ELSE ret END AS ret, data FROM calls)
)
SELECT pid, tid, ts_ns, seq, last.buf AS buf, last.at AS enter_ns, CAST(ret AS BIGINT) AS data_len,
  left(data, CAST(ret AS BIGINT)) AS data
FROM seen WHERE NOT enters AND ret > 0 AND last.stored"""

LOADS = """
loads AS (
  SELECT CAST(user_id AS VARCHAR) AS load_id, epoch_us(ts) AS loaded_us,
    CAST(CASE WHEN event_type = 'signup' AND value > 150 THEN 70000 ELSE floor(value * 100) END AS BIGINT) AS port,
    CASE event_type WHEN 'click' THEN 'TCP' WHEN 'view' THEN 'tcp' WHEN 'error' THEN 'Udp' WHEN 'signup' THEN 'sctp'
      ELSE 'udp' END AS protocol
  FROM events
), judged AS (
  SELECT *, CASE lower(protocol) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 END AS proto,
    CASE WHEN port NOT BETWEEN 0 AND 65535 THEN 'bad_port'
      WHEN lower(protocol) NOT IN ('tcp', 'udp') THEN 'unsupported_protocol' END AS reject_reason
  FROM loads
)"""

UNUSUAL = f"""{TRAFFIC}, {ALLOW}, made AS (
  SELECT seq, ts_ns, CASE WHEN seq % 17 = 0 THEN 2130706433 ELSE src_ip END AS src_ip,
    CASE WHEN seq % 19 = 0 THEN 22 ELSE src_port END AS src_port, CASE WHEN seq % 23 = 0 THEN 0 ELSE dst_port END AS dst_port,
    CASE WHEN seq % 29 = 0 THEN 1 ELSE proto END AS proto, n_vlan * 4 AS tags,
    CASE WHEN seq % 31 = 0 THEN 0 ELSE strlen(payload) END AS body, seq % 37 = 0 AS other,
    CASE WHEN seq % 7 = 0 THEN seq // 7 % 60 ELSE 1000000 END AS cut
  FROM traffic
), sized AS (
  SELECT *, least(cut, 14 + tags + CASE WHEN proto = 6 THEN 40 ELSE 28 END + body) AS size FROM made
), unusual AS (
  SELECT *, CASE WHEN size < 14 THEN 'short_eth' WHEN size < 14 + tags THEN 'short_vlan' WHEN other THEN 'not_ipv4'
    WHEN size < 34 + tags THEN 'short_ip' WHEN proto NOT IN (6, 17) THEN 'not_tcp_udp'
    WHEN size < 34 + tags + CASE WHEN proto = 6 THEN 20 ELSE 8 END THEN 'short_l4' ELSE 'ok' END AS status,
    EXISTS (SELECT 1 FROM allow a WHERE src_ip >= a.low AND src_ip < a.low + a.size) AS allowed
  FROM sized
)"""

SQL = {
    "captured_fields": f"""WITH {TRAFFIC}
SELECT dst_port, count(*) AS captured, count(*) FILTER (json_valid(payload)) AS parsed,
  CAST(sum(CAST(payload ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(payload ->> '$.k' AS BIGINT)) AS max_k
FROM traffic WHERE (dst_port, proto) IN ((443, 6), (8080, 6), (514, 17)) GROUP BY dst_port""",
    "decode_flows": f"""WITH {TRAFFIC}
SELECT seq, ts_ns, src_ip, dst_ip, src_port, dst_port, proto, n_vlan, CAST(strlen(payload) AS INT) AS payload_len,
  'ok' AS decode_status FROM traffic""",
    "decode_status": f"""WITH {TRAFFIC}, cut AS (
  SELECT *, least(seq % 80, 14 + 4 * n_vlan + CASE WHEN proto = 6 THEN 40 ELSE 28 END + strlen(payload)) AS size
  FROM traffic
), judged AS (
  SELECT CASE WHEN size < 14 THEN NULL ELSE
      CASE WHEN n_vlan = 2 AND size < 18 THEN 1 ELSE n_vlan END END AS n_vlan,
    CASE WHEN size < 14 THEN 'short_eth' WHEN size < 14 + 4 * n_vlan THEN 'short_vlan'
      WHEN size < 34 + 4 * n_vlan THEN 'short_ip'
      WHEN size < 34 + 4 * n_vlan + CASE WHEN proto = 6 THEN 20 ELSE 8 END THEN 'short_l4' ELSE 'ok' END AS decode_status
  FROM cut
) SELECT n_vlan, decode_status, count(*) AS rows FROM judged GROUP BY ALL""",
    "capture_inline": f"""WITH {TRAFFIC}
SELECT seq, ts_ns, CAST(strlen(payload) AS BIGINT) AS data_len, payload AS data, true AS complete
FROM traffic WHERE (dst_port, proto) IN ((443, 6), (8080, 6), (514, 17)) AND strlen(payload) BETWEEN 1 AND 1024""",
    "capture_reasons": f"""WITH {TRAFFIC}
SELECT CASE WHEN (dst_port, proto) NOT IN ((443, 6), (8080, 6), (514, 17)) THEN 'not_of_interest'
  WHEN strlen(payload) = 0 THEN 'empty_payload' WHEN strlen(payload) > 1024 THEN 'delegated_large'
  ELSE 'captured' END AS capture_reason, count(*) AS rows FROM traffic GROUP BY 1""",
    "allowlist_lpm": f"""WITH {TRAFFIC}, {ALLOW}
SELECT t.seq, t.src_ip, max(a.plen) AS allow_plen
FROM traffic t LEFT JOIN allow a ON t.src_ip >= a.low AND t.src_ip < a.low + a.size GROUP BY t.seq, t.src_ip""",
    "allowlist_members": f"""WITH {TRAFFIC}, {ALLOW}
SELECT seq, '10.0.' || ((src_ip // 256) % 256) || '.' || (src_ip % 256) AS src FROM traffic
WHERE EXISTS (SELECT 1 FROM allow WHERE src_ip >= low AND src_ip < low + size)""",
    "edge_verdict": f"{EDGE} SELECT * FROM verdicts",
    "reason_counts": f"{EDGE} SELECT edge_reason, count(*) AS rows FROM verdicts GROUP BY 1",
    "drop_total": f"{EDGE} SELECT count(*) FILTER (rate_limited) AS dropped FROM verdicts",
    "rate_check": f"""WITH RECURSIVE {TRAFFIC}, {windows("traffic", "src_ip, dst_port", THREE_DAYS)}
SELECT seq, ts_ns, src_ip, dst_port, window_start, n, n > 1 AS limited FROM counted""",
    "rate_check_hot": f"""WITH RECURSIVE {TRAFFIC}, {windows("traffic", "dst_port", HOUR)}
SELECT seq, ts_ns, dst_port, window_start, n, n > 2 AS limited FROM counted""",
    "json_parse": f"WITH {DAMAGED} SELECT event_id, reject_reason IS NULL AS accepted, reject_reason FROM judged",
    "json_fields": """SELECT event_id, unnest(json_keys(props)) AS key, CAST(props ->> '$.k' AS BIGINT) AS value,
  CAST(props ->> '$.k' AS BIGINT) AS k FROM events""",
    "json_documents": """SELECT doc_id, md5(text) AS text_md5, lang, true AS accepted FROM documents""",
    "ndjson_lines": """SELECT event_id, '{"k":' || (props ->> '$.k') || '}' AS value FROM events""",
    "json_candidates": """SELECT source, count(*) AS rows FROM (
  SELECT 'events' AS source, props AS text FROM events UNION ALL SELECT 'documents', text FROM documents
) WHERE left(text, 1) IN ('{', '[') GROUP BY 1""",
    "stage_counts": f"""WITH {DAMAGED}
SELECT count(*) AS events, count(*) FILTER (reject_reason IS NULL) AS accepted, CAST(0 AS BIGINT) AS structural_drops,
  count(*) FILTER (reject_reason IS NOT NULL) AS parser_drops FROM judged""",
    "route_by_size": """SELECT CASE WHEN size <= 1024 THEN 'inline' ELSE 'large' END AS route, count(*) AS rows,
  CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest
FROM (SELECT strlen(text) AS size FROM documents WHERE strlen(text) > 0) GROUP BY 1""",
    "resolve_payloads": """SELECT doc_id AS seq, CASE WHEN strlen(text) <= 1024 THEN 'tc' ELSE 'sk_msg' END AS source,
  CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest,
  true AS resolved
FROM documents WHERE strlen(text) > 0""",
    "resolve_hot": """SELECT e.event_id AS seq,
  CASE WHEN e.event_id % 11 <> 0 AND d.doc_id IS NOT NULL THEN md5(d.text) END AS digest,
  CASE WHEN d.doc_id IS NULL THEN 'bad_ref' WHEN e.event_id % 11 = 0 THEN 'short_payload' END AS reject_reason
FROM events e LEFT JOIN (SELECT * FROM documents WHERE strlen(text) > 0) d ON d.doc_id = e.user_id""",
    "retain_latest": f"""WITH {TRAFFIC}
SELECT seq, ts_ns, strlen(payload) AS n_bytes FROM traffic ORDER BY ts_ns DESC, seq DESC LIMIT 100""",
    "retain_latest_by_source": f"""WITH {TRAFFIC}
SELECT src_ip, seq, ts_ns FROM traffic
QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts_ns DESC, seq DESC) <= 3""",
    "pair_calls": "WITH " + PAIRS.format(pid="user_id + 1000", tid="user_id"),
    "pair_calls_hot": "WITH " + PAIRS.format(pid="CAST(1 AS BIGINT)", tid="CAST(1 AS BIGINT)"),
    "first_seen": """SELECT CAST(user_id + 8000 AS INT) AS local_port, 6 AS proto, 'c' || event_id AS conn_key,
  epoch_us(ts) * 1000 AS ts_ns, event_id AS seq FROM events WHERE event_type IN ('click', 'view')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "registered_messages": """SELECT CAST(8000 + doc_id % 7 AS INT) AS local_port, count(*) AS rows,
  CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents
WHERE 8000 + doc_id % 7 IN (
  SELECT user_id + 8000 FROM events WHERE event_type IN ('click', 'view')
) AND doc_id % 7 % 2 = 0 GROUP BY 1""",
    "interest_normalize": f"""WITH {LOADS}
SELECT proto, reject_reason, count(*) AS rows, CAST(sum(port) AS BIGINT) AS port_sum FROM judged GROUP BY 1, 2""",
    "interest_effective": f"""WITH {LOADS}
SELECT CAST(port AS INT) AS port, proto, min(loaded_us) AS loaded_us FROM judged
WHERE reject_reason IS NULL AND load_id NOT IN (SELECT load_id FROM judged WHERE reject_reason = 'bad_port')
GROUP BY 1, 2""",
    "tuning_in_force": f"""WITH {TRAFFIC}, {TUNING}
SELECT seq, ts_ns, version, max_rate_pps, sampling_num, sampling_den FROM tuned""",
    "sampled": f"""WITH {TRAFFIC}, {TUNING}
SELECT version, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seq_sum FROM tuned
WHERE seq % sampling_den < sampling_num GROUP BY 1""",
    "rate_check_tuned": f"""WITH RECURSIVE {TRAFFIC}, {TUNING}, {windows("tuned", "src_ip, dst_port", THREE_DAYS)}
SELECT seq, window_start, n, max_rate_pps, n > max_rate_pps AS limited FROM counted""",
    "record_decode": """SELECT event_id AS seq, CASE WHEN whole THEN user_id END AS conn_id,
  CASE WHEN whole THEN user_id + 1000 END AS pid, CASE WHEN whole THEN event_id END AS tid,
  CASE WHEN whole THEN epoch_us(ts) * 1000 END AS ts_ns, CASE WHEN whole THEN is_ref END AS is_ref,
  CASE WHEN whole AND is_ref THEN event_id * 64 END AS payload_ref,
  CASE WHEN whole THEN CAST(strlen(props) AS BIGINT) END AS data_len,
  CASE WHEN whole AND NOT is_ref THEN props END AS data, CASE WHEN NOT whole THEN 'short_record' END AS reject_reason
FROM (SELECT *, event_id % 13 <> 0 AS whole, event_id % 5 = 0 AS is_ref FROM events)""",
    "tuning_records": """SELECT event_type, arg_max(event_id, (ts, event_id)) AS version,
  arg_max(user_id, (ts, event_id)) AS max_rate_pps, CAST(1 AS BIGINT) AS sampling_num, CAST(10 AS BIGINT) AS sampling_den
FROM events GROUP BY 1""",
    "clamp_documents": """SELECT doc_id AS seq, CAST(least(strlen(text), 1000) AS BIGINT) AS size,
  CAST(strlen(text) AS BIGINT) AS original_size, strlen(text) > 1000 AS truncated,
  md5(array_slice(encode(text), 1, 1000)) AS digest FROM documents WHERE strlen(text) > 0""",
    "rejects_roundtrip": f"""WITH {DAMAGED} SELECT event_id AS seq, reject_reason, data
FROM judged JOIN damaged USING (event_id) WHERE reject_reason IS NOT NULL""",
    "resolve_repeated_refs": """SELECT doc_id AS seq,
  CASE WHEN strlen(reverse(text)) >= strlen(text) THEN md5(array_slice(encode(reverse(text)), 1, strlen(text))) END AS digest,
  CASE WHEN strlen(reverse(text)) < strlen(text) THEN 'short_payload' END AS reject_reason
FROM documents WHERE strlen(text) > 0""",
    "tuning_short_records": f"""WITH {TRAFFIC}, records AS (
  SELECT epoch_us(ts) * 1000 AS since, event_id, user_id FROM events WHERE event_id % 3 <> 0
)
SELECT seq, coalesce(r.event_id, 1) AS version, coalesce(r.user_id, 1000) AS max_rate_pps
FROM traffic LEFT JOIN (
  SELECT since, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM records GROUP BY since
) r ON r.since = (SELECT max(since) FROM records WHERE since <= traffic.ts_ns)""",
    "event_times": "SELECT event_id AS seq, epoch_us(ts) AS ts_us FROM events",
    "address_text": f"""WITH {TRAFFIC}
SELECT '10.0.' || ((src_ip // 256) % 256) || '.' || (src_ip % 256) AS src, src_ip, count(*) AS rows
FROM traffic GROUP BY src_ip""",
    "records_without_payloads": """SELECT seq, CASE WHEN NOT whole THEN 'short_record' WHEN len = 0 THEN 'empty'
    WHEN len > 1048576 THEN 'too_large' WHEN is_ref THEN 'bad_ref' WHEN len > 1024 THEN 'bad_inline_len' END AS reject_reason,
  CASE WHEN whole AND NOT is_ref AND len BETWEEN 1 AND 1024 THEN props END AS data
FROM (
  SELECT event_id AS seq, props, event_id % 13 <> 0 AS whole, event_id % 5 = 0 AS is_ref,
    CASE WHEN event_id % 7 = 0 THEN 5000 WHEN event_id % 11 = 0 THEN 2000000 WHEN event_id % 17 = 0 THEN 0
      ELSE strlen(props) END AS len
  FROM events
)""",
    "edge_reasons": f"""WITH RECURSIVE {UNUSUAL}, decided AS (
  SELECT *, CASE WHEN status IN ('short_eth', 'short_vlan', 'not_ipv4', 'short_ip') THEN status
    WHEN src_ip = 2130706433 THEN 'bypass_loopback'
    WHEN status = 'ok' AND proto = 6 AND 22 IN (dst_port, src_port) THEN 'bypass_ssh'
    WHEN NOT allowed THEN 'not_allowlisted' WHEN status = 'short_l4' THEN status
    WHEN status <> 'ok' OR dst_port = 0 THEN 'pass'
    WHEN dst_port <> 22 AND (dst_port, proto) NOT IN ((443, 6), (8080, 6), (514, 17)) THEN 'not_of_interest' END AS reason
  FROM unusual
), reaching AS (SELECT * FROM decided WHERE reason IS NULL),
{windows("reaching", "src_ip, dst_port", THREE_DAYS)}
SELECT seq, reason AS edge_reason, CAST(NULL AS BIGINT) AS rate_window_start, CAST(NULL AS BIGINT) AS rate_count
FROM decided WHERE reason IS NOT NULL
UNION ALL
SELECT seq, CASE WHEN n > 1 THEN 'rate_limited' ELSE 'pass' END, window_start, n FROM counted""",
    "capture_reasons_unusual": f"""WITH {UNUSUAL}
SELECT seq, CASE WHEN status <> 'ok' THEN status
  WHEN (dst_port, proto) NOT IN ((443, 6), (8080, 6), (514, 17)) THEN 'not_of_interest' WHEN body = 0 THEN 'empty_payload'
  WHEN body > 1024 THEN 'delegated_large' ELSE 'captured' END AS capture_reason
FROM unusual""",
    "pair_calls_cut": "WITH paired AS (WITH " + PAIRS.format(pid="user_id + 1000", tid="user_id") + """)
SELECT pid, tid, ts_ns, seq, buf, enter_ns, least(data_len, 5) AS data_len, left(data, 5) AS data,
  data_len AS original_size, data_len > 5 AS truncated FROM paired""",
    "tuning_long_log": f"""WITH {TRAFFIC}, changes AS (
  SELECT epoch_us(ts) * 1000 AS since, max(event_id) AS version, arg_max(user_id, event_id) AS max_rate_pps
  FROM events WHERE event_type = 'error' GROUP BY 1
)
SELECT seq, ts_ns, coalesce(version, 1) AS version, coalesce(max_rate_pps, 1000) AS max_rate_pps,
  CAST(1 AS BIGINT) AS sampling_num, coalesce(version % 9 + 1, 1) AS sampling_den
FROM traffic ASOF LEFT JOIN changes ON ts_ns >= since""",
    "json_numbers": r"""SELECT event_id, CASE WHEN fits THEN user_id END AS k, CASE WHEN fits THEN '1e999 \"' END AS s,
  CASE WHEN NOT fits THEN 'bad_json' END AS reject_reason
FROM (SELECT event_id, user_id, event_id % 620 <= 308 AS fits FROM events)""",
    "allowlist_intervals": f"""WITH {TRAFFIC}, prefixes AS (
  SELECT DISTINCT s_suppkey % 20 + 14 AS plen, (167772160 + s_suppkey * 37 % 5000) >> (32 - (s_suppkey % 20 + 14)) AS head
  FROM supplier WHERE s_suppkey % 20 + 14 <= 32
)
SELECT seq, src_ip, CAST((SELECT max(plen) FROM prefixes WHERE src_ip >> (32 - plen) = head) AS INT) AS allow_plen FROM traffic""",
    "stream_waiting_pointers": """SELECT CASE WHEN doc_id % 9 = 0 THEN 'rejects' ELSE 'logs' END AS channel,
  CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS digest, CASE WHEN doc_id % 9 = 0 THEN doc_id END AS seq,
  CASE WHEN doc_id % 9 = 0 THEN 'bad_ref' END AS reject_reason
FROM documents""",
}

# The same rows, whether they come at once or as a stream.
SQL |= {
    "stream_rate_check": SQL["rate_check"], "stream_pair_calls": SQL["pair_calls"],
    "stream_retain_latest": SQL["retain_latest_by_source"], "stream_edge_verdict": SQL["edge_verdict"],
    "stream_edge_counts": SQL["reason_counts"],
}
