from .calls import pair_calls_batches, pair_calls_stream
from .dataflow import run_stream, stream_counts
from .pipeline import flush_event_logs, stream_event_logs, stream_logs
from .rate import rate_batches, rate_stream
from .retain import retain_batches, retained

__all__ = [
    "flush_event_logs", "pair_calls_batches", "pair_calls_stream", "rate_batches", "rate_stream", "retain_batches",
    "retained", "run_stream", "stream_counts", "stream_event_logs", "stream_logs",
]
