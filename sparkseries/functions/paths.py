"""Device names taken from file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """File name without folder and without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "\\.[^.]*$", "")


def plain_path(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def relative_path(path: Column, root: str) -> Column:
    """What follows the data folder in a path, without a leading slash.

    ``root`` is absolute; the path may carry a scheme. Where the path does not begin with the root
    (patterns), its last occurrence counts.
    """
    folder = root.rstrip("/") + "/"
    plain = plain_path(path)
    rest = F.when(
        F.startswith(plain, F.lit(folder)), F.substr(plain, F.lit(len(folder) + 1))
    ).otherwise(F.substring_index(plain, folder, -1))
    return F.regexp_replace(rest, "^/+", "")


def decoded_path(path: Column) -> Column:
    """A path as users write it; Spark reports it URL-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def parent_of(path: Column, marker: str) -> Column:
    """What stands before the folder ``/marker``."""
    return F.substring_index(path, "/" + marker, 1)
