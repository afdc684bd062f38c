from .interest import (
    accepted_loads, append_interest, effective_interest, normalize_interest, read_interest, read_loads,
)
from .records import read_records, read_records_stream
from .tables import log_lines, read_table_stream, write_logs
from .tuning import decode_tuning, latest_tuning, tuning_record

__all__ = [
    "accepted_loads", "append_interest", "decode_tuning", "effective_interest", "latest_tuning", "log_lines",
    "normalize_interest", "read_interest", "read_loads", "read_records", "read_records_stream",
    "read_table_stream",
    "tuning_record", "write_logs",
]
