"""Operators: DataFrame in, DataFrame out."""

from .layout import (
    any_present,
    group_points,
    long_to_wide,
    null_skip,
    points,
    rejoin,
    sensor_columns,
    sparse_rows,
    vertical_split,
    wide_to_long,
    wide_to_typed_long,
)
from .queries import (
    align_long_query,
    align_query,
    between,
    count_query,
    count_range,
    downsample,
    keep_last,
    range_scan_count,
    raw_query,
    result_size,
)
from .ranking import first_rows, first_rows_per_group, number_rows
from .reports import (
    age_rollup,
    batch_latency,
    latency_report,
    load_report,
    output_size,
    query_latencies,
)
from .schema import (
    apply_catalog,
    apply_schema,
    infer_column_types,
    infer_types,
    merge_schemas,
    to_struct,
    union_tables,
    with_type_name,
)
from .transforms import (
    extend_series,
    jitter_time,
    lines_with_ids,
    shuffle_batches,
    split_by_id,
    write_split,
)
from .windows import age_windows, count_age_windows, moving_mean, update_age_windows
