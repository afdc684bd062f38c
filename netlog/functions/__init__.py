from .barrier import compute_once
from .bits import be_sql, clamp, le_words, monotonic_to_timestamp, split_pid_tid, u_be, u_le
from .documents import has_lone_surrogate, is_json_object_text, strict_json
from .network import cidr_net, cidr_plen, ip_text, ip_value, protocol_number

__all__ = [
    "be_sql", "cidr_net", "cidr_plen", "clamp", "compute_once", "ip_text", "ip_value", "has_lone_surrogate", "is_json_object_text",
    "le_words", "monotonic_to_timestamp", "protocol_number", "split_pid_tid", "strict_json", "u_be", "u_le",
]
