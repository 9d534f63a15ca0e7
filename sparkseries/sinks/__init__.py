"""Writers: stored tables and text payloads."""

from .loads import count_loads, ledger, load_table, loaded_rows, scan_loads
from .parts import read_joined_parts, write_joined_parts
from .payloads import json_points, line_protocol, metric_points, record_payload
from .tables import (
    TIME_CHUNK_MS,
    read_parts,
    write_discard,
    write_parts,
    write_table,
    write_text,
    with_time_chunk,
)

__all__ = [
    "TIME_CHUNK_MS", "count_loads", "json_points", "ledger", "line_protocol", "load_table",
    "loaded_rows", "metric_points", "read_joined_parts", "read_parts", "record_payload",
    "scan_loads", "with_time_chunk", "write_discard", "write_joined_parts", "write_parts",
    "write_table", "write_text",
]
