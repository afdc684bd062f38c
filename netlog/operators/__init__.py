from .asof import as_of
from .calls import open_calls, pair_calls
from .decode import FLOW_COLUMNS, decode_frames
from .endpoints import first_seen, registered_messages
from .logs import candidates, field, flatten, parse_logs, to_line, with_fields
from .metrics import drop_total, observe_rejects, reason_counts, stage_counts
from .payloads import (
    capture_inline, clamp_messages, decode_records, delegated_large, merge_sources, message_events,
    message_payloads, record_reject, resolve_payloads, retain_latest, size_route, with_payload,
)
from .policy import (
    allowlist_join, allowlist_rejects, capture_verdict, edge_verdict, flag_allowlist, flag_interest, interest_join,
    interest_set, prefix_intervals,
)
from .ratelimit import open_windows, rate_check
from .tuning import sample, tuning_in_force

__all__ = [
    "FLOW_COLUMNS", "allowlist_join", "allowlist_rejects", "as_of", "candidates", "capture_inline", "capture_verdict", "clamp_messages", "delegated_large",
    "decode_frames", "decode_records", "drop_total", "edge_verdict", "field", "first_seen", "flag_allowlist",
    "flag_interest", "flatten", "interest_join", "interest_set", "merge_sources", "message_events",
    "message_payloads", "observe_rejects", "open_calls", "open_windows", "pair_calls", "parse_logs", "prefix_intervals", "rate_check", "reason_counts",
    "record_reject", "registered_messages", "resolve_payloads", "retain_latest", "sample", "size_route",
    "stage_counts", "to_line", "tuning_in_force", "with_fields", "with_payload",
]
