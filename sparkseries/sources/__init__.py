"""Readers; each gives the canonical wide table or a long one."""

from .csv_series import CsvSeries, read_csv_points, read_csv_series
from .files import files_table, list_files, read_type_catalog
from .lines import head_lines, number_lines, read_lines
from .mlab import count_mlab_clients, read_mlab_ip, read_mlab_utilization
from .names import devices_ending, scan_suffix, update_device_names
from .stored import scan_orc, scan_parquet
from .synthetic import generate_wide, read_synthetic
from .tracks import read_geolife, read_noaa, read_redd, read_tdrive

__all__ = [
    "CsvSeries", "count_mlab_clients", "devices_ending", "files_table", "generate_wide", "head_lines",
    "list_files", "number_lines",
    "read_csv_points", "read_csv_series", "read_geolife", "read_lines", "read_mlab_ip",
    "read_mlab_utilization", "read_noaa", "read_redd", "read_synthetic", "read_tdrive",
    "read_type_catalog", "scan_orc", "scan_parquet", "scan_suffix", "update_device_names",
]
