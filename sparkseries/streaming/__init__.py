"""Streaming forms of loading and downsampling."""

from .batches import batch_progress, ingest_batches, payload_stream, read_messages, run_batches
from .late import late_stream, stored_rows, window_totals
from .streams import downsample_stream, ingest_stream, progress_report, read_stream

__all__ = [
    "batch_progress", "downsample_stream", "ingest_batches", "ingest_stream", "late_stream",
    "payload_stream", "progress_report", "read_messages", "read_stream", "run_batches",
    "stored_rows", "window_totals",
]
