"""Column expressions; all of them stay on the JVM side."""

from .names import cut_position, device_part, field_part, normalize_name
from .paths import decoded_path, file_stem, parent_of, plain_path, relative_path
from .times import bucket_start, epoch_ms, ms_to_ns, parse_time, seconds_to_ms, time_bound
from .values import (
    infer_type_rank,
    missing,
    pad_row,
    quote_text,
    safe_parse,
    sql_escape_text,
    sql_identifier,
    strip_outer_quotes,
)

__all__ = [
    "bucket_start", "cut_position", "decoded_path", "device_part", "epoch_ms", "field_part", "file_stem",
    "infer_type_rank", "missing", "ms_to_ns", "normalize_name", "pad_row", "parent_of", "parse_time", "plain_path", "quote_text",
    "relative_path", "safe_parse", "seconds_to_ms", "sql_escape_text", "sql_identifier",
    "strip_outer_quotes", "time_bound",
]
