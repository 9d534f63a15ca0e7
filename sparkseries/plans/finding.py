"""Files by number, devices from file names, devices by suffix, lines by the ids in them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_ms
from ..operators import align_query, lines_with_ids, result_size, shuffle_batches, write_split
from ..sinks import write_table
from ..sources import (
    CsvSeries,
    files_table,
    read_csv_series,
    read_lines,
    read_noaa,
    read_redd,
    read_tdrive,
    scan_suffix,
    update_device_names,
)
from ..sources.stored import open_table
from ..storage import new_path
from .registry import EVENT_POINTS, event_points, registered, table
from .series import DAY, JANUARY


def _named_files(rows: DataFrame, path: str, name: Column, order: Column, line: Column) -> str:
    """A text file for each name below ``path``, its lines in order; a task that is repeated writes it anew."""
    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = FileSystem.from_uri(path)
        now, out = None, None
        for part in parts:
            for file, lines in part.groupby("name", sort=False)["line"]:
                if file != now:
                    if out:
                        out.close()
                    now, target = file, f"{root}/{file}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(target)
                out.write("".join(f"{x}\n" for x in lines).encode())
            yield part[["name"]].drop_duplicates()
        if out:
            out.close()

    lines = rows.select(name.alias("name"), order.alias("order"), line.alias("line"))
    sorted_lines = lines.repartition("name").sortWithinPartitions("name", "order").select("name", "line")
    sorted_lines.mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
    return path


def _files_by_type(spark, sf_dir) -> str:
    """The event ids of each type as a file in the folder of its first letter."""
    kind = F.col("event_type")
    return _named_files(
        table(spark, sf_dir, "events"), new_path(spark, "numbered"),
        F.concat(F.substring(kind, 1, 1), F.lit("/"), kind, F.lit(".txt")), F.col("event_id"),
        F.col("event_id").cast("string"),
    )


@registered("numbered_files", """
    with files as (
        select row_number() over (order by event_type) - 1 as number, event_type || '.txt' as name,
               sum(length(event_id::varchar) + 1)::bigint as bytes
        from events group by event_type
    ) select * from files where number between 1 and 3""")
def numbered_files(spark, sf_dir):
    """Files 1 to 3 in path order."""
    files = files_table(spark, _files_by_type(spark, sf_dir), 1, 3)
    return files.select("number", F.substring_index("file", "/", -1).alias("name"), "bytes")


@registered("numbered_lines", """
    select event_id, event_type || '.txt' as name from events
    where event_type in (select event_type from events group by 1 order by 1 limit 3 offset 1)""")
def lines_of_numbered_files(spark, sf_dir):
    """The lines of files 1 to 3."""
    path = _files_by_type(spark, sf_dir)
    lines = read_lines(spark, path, files_table(spark, path, 1, 3))
    return lines.select(
        F.col("value").cast("bigint").alias("event_id"), F.substring_index("file", "/", -1).alias("name"))


@registered("tdrive_files", f"""
    select "time" // 1000 * 1000 as "time", replace("deviceId", 'root.u', 'root.group_0.d_')
           as "deviceId", value as longitude, cast(event_id as double) as latitude
    from ({EVENT_POINTS})""")
def tdrive_files(spark, sf_dir):
    """A file for each taxi, named by it; the id in the lines is another."""
    line = F.concat_ws(
        ",", F.lit("0"), F.date_format(F.timestamp_millis(epoch_ms(F.col("ts"))), "yyyy-MM-dd HH:mm:ss"),
        F.col("value").cast("string"),
        F.col("event_id").cast("string"),
    )
    name = F.concat(F.col("user_id").cast("string"), F.lit(".txt"))
    events = table(spark, sf_dir, "events")
    path = _named_files(events, new_path(spark, "taxis"), name, F.col("event_id"), line)
    return read_tdrive(spark, path, zone=spark.conf.get("spark.sql.session.timeZone"))


@registered("redd_files", f"""
    select "time" // 1000 * 1000 as "time",
           'root.group_0.d_house_' || event_type || '_channel_' || event_id % 3 as "deviceId", value
    from ({EVENT_POINTS})""")
def redd_files(spark, sf_dir):
    """A file for each channel in the folder of its house."""
    points = event_points(spark, sf_dir)
    name = F.concat(
        F.lit("house_"), F.col("event_type"), F.lit("/channel_"), (F.col("event_id") % 3).cast("string"),
        F.lit(".dat"),
    )
    line = F.concat_ws(" ", F.expr("time div 1000").cast("string"), F.col("value").cast("string"))
    return read_redd(spark, _named_files(points, new_path(spark, "meters"), name, F.col("event_id"), line))


@registered("noaa_files", """
    select epoch_us(o_orderdate) // 1000 + 2209046400000 as "time",
           'root.group_0.d_' || lpad((o_custkey % 40)::varchar, 6, '0') || '_99999' as "deviceId",
           (o_orderkey % 100)::double as "TEMP"
    from orders""")
def noaa_files(spark, sf_dir):
    """A file for each station and year, named by station, second number and year."""
    orders = table(spark, sf_dir, "orders")
    station = F.lpad((F.col("o_custkey") % 40).cast("string"), 6, "0")
    name = F.concat(station, F.lit("-99999-"), F.date_format("o_orderdate", "yyyy"), F.lit(".op"))
    empty = "999999 99999  {day}    {temp}  4  9999.9  0  9999.9  0  9999.9  0  999.9  0  999.9  0  999.9  999.9   999.9   999.9  99.99  999.9  000000"
    head, rest = empty.split("{day}")
    gap, tail = rest.split("{temp}")
    line = F.concat(
        F.lit(head), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(gap[:2]),
        F.lpad((F.col("o_orderkey") % 100).cast("double").cast("string"), 6, " "), F.lit(tail),
    )
    path = _named_files(orders, new_path(spark, "stations"), name, F.col("o_orderkey"), line)
    return read_noaa(spark, path).select("time", "deviceId", "TEMP")


@registered("csv_first_lines", f"""
    select "time", event_type as "deviceId", case when place <= 3 then event_id end as v
    from (select *, row_number() over (partition by event_type order by event_id) as place
          from ({EVENT_POINTS}))""")
def csv_first_lines(spark, sf_dir):
    """Types from the first three lines of each file; later cells that do not fit are null."""
    points = event_points(spark, sf_dir).select("time", "event_type", "event_id")
    third = points.groupBy("event_type").agg(
        F.get(F.sort_array(F.slice(F.sort_array(F.collect_set("event_id")), 1, 3)), F.lit(2)).alias("third"))
    value = F.when(F.col("event_id") > F.col("third"), F.concat(F.lit("x"), F.col("event_id").cast("string")))
    lines = points.join(third, "event_type").select(
        "event_type", "event_id",
        F.concat_ws(",", "time", F.coalesce(value, F.col("event_id").cast("string"))).alias("line"),
    )
    heads = third.select("event_type", F.lit(-1).cast("bigint").alias("event_id"), F.lit("Time,v").alias("line"))
    path = _named_files(
        lines.union(heads), new_path(spark, "first-lines"),
        F.concat(F.col("event_type"), F.lit(".csv")), F.col("event_id"), F.col("line"),
    )
    return read_csv_series(spark, path, CsvSeries(infer_rows=3, normalize=False))


@registered("suffix_by_name", f"""
    select "time", "deviceId", value from ({EVENT_POINTS})
    where ends_with("deviceId", '7') and "time" between {JANUARY + 3 * DAY} and {JANUARY + 20 * DAY}""")
def suffix_by_name(spark, sf_dir):
    """Rows of the devices that end with 7, found in a list of names that two loads kept up."""
    points = event_points(spark, sf_dir).select("time", "deviceId", "value")
    path, names = new_path(spark, "suffixes"), new_path(spark, "names")
    write_table(points, path, "parquet", "single")
    update_device_names(points.where("time % 2 = 0"), names, "overwrite")
    update_device_names(points, names)
    return scan_suffix(spark, path, names, ["value"], "7", JANUARY + 3 * DAY, JANUARY + 20 * DAY)


# Ids of a few to many characters, some of them parts of others.
IDS = """
    select doc_id::varchar as id from labels
    union select substr(text, 11, 24) from benchmark
    union select substr(text, 3, 5) from benchmark
    union select substr(text, 1, 80) from benchmark
"""


def _ids(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark")
    parts = [passages.select(F.substring("text", at, n).alias("id")) for at, n in ((11, 24), (3, 5), (1, 80))]
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return reduce(lambda a, b: a.union(b), parts, labels)


@registered("lines_with_ids", f"""
    select doc_id, id from documents join ({IDS}) on contains(text, id) where id <> ''""")
def documents_with_ids(spark, sf_dir):
    """Documents and the listed ids that their texts contain."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines_with_ids(documents, _ids(spark, sf_dir), "text", "doc_id", "id").select("doc_id", "id")


@registered("split_folders", """
    select doc_id, source, id from documents join (select doc_id::varchar as id from labels) on contains(text, id)""")
def split_folders(spark, sf_dir):
    """A folder for each listed number, with the documents that contain it; read back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    path = new_path(spark, "folders")
    write_split(documents, labels, "id", path, ["doc_id", "source"], text="text", key="doc_id")
    return open_table(spark, path, "parquet").select("doc_id", "source", "id")


@registered("result_characters", """
    select count(*) as lines, count(*) * 2 as points, count(*) * 3 as cells,
           sum(length('{"doc_id":,"quality":,"toxic":}') + length(doc_id::varchar) + length(quality::varchar)
               + length(toxic::varchar))::bigint as characters
    from labels""")
def result_characters(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return result_size(align_query(labels, ["quality", "toxic"], time="doc_id", tag=None))


@registered("shuffled_order", f"""
    select share, event_id // 100 as batch, share = 0 as in_order, count(*) as rows
    from events, (values (0), (1)) s(share) group by all having count(*) > 20""")
def shuffled_order(spark, sf_dir):
    """Without a share every batch keeps its order, with all of them none does."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 100").alias("batch"))
    seen = []
    for share in (0, 1):
        placed = shuffle_batches(rows, "batch", "event_id", float(share))
        placed = placed.withColumn("place", F.monotonically_increasing_id())
        order = F.sort_array(F.collect_list(F.struct("place", "event_id")))["event_id"]
        seen.append(placed.groupBy("batch").agg(order.alias("ids")).select(
            F.lit(share).alias("share"), "batch", (F.col("ids") == F.sort_array("ids")).alias("in_order"),
            F.size("ids").cast("bigint").alias("rows"),
        ))
    return seen[0].union(seen[1]).where("rows > 20")
