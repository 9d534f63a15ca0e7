"""Sources and sinks: files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge_schemas, output_size, with_type_name
from ..sinks import read_parts, with_time_chunk, write_parts, write_table, write_text
from ..sources import (
    CsvSeries,
    count_mlab_clients,
    number_lines,
    read_csv_points,
    read_csv_series,
    read_geolife,
    read_lines,
    read_mlab_ip,
    read_mlab_utilization,
    read_noaa,
    read_redd,
    read_tdrive,
    read_type_catalog,
    scan_parquet,
)
from ..sources.csv_series import infer_file_schemas, read_headers
from ..storage import new_path
from .registry import EVENT_POINTS, event_points, registered, table
from .series import EVENT_TYPES


def _csv_files(spark, sf_dir) -> str:
    """CSV files with two kinds of headers; `value` is an integer in one and not in the other."""
    path = new_path(spark, "csv")
    events = event_points(spark, sf_dir)
    for event in EVENT_TYPES:
        rows = events.where(F.col("event_type") == event)
        prefix = f"root.{event}"
        if event < "purchase":
            columns = [
                F.col("time").alias("Time"),
                F.floor("value").alias(f"{prefix}.value"),
                F.concat(F.lit("'"), F.col("deviceId"), F.lit("'")).alias(f"{prefix}.user-id"),
            ]
        else:
            iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
            columns = [
                iso.alias("Time"),
                F.col("event_id").alias(f"{prefix}.number"),
                F.when(F.col("value") >= 50, F.col("value")).alias(f"{prefix}.value"),
            ]
        writer = rows.select(*columns).write.option("header", True).option("sep", "@")
        writer.option("emptyValue", "").csv(f"{path}/{event}")
    return path


_OPTIONS = CsvSeries(sep="@", zone="UTC")

_CSV_ROWS = f"""
    select "time", 'root.a' || event_type as "deviceId",
           case when event_type >= 'purchase' then event_id end as anumber,
           case when event_type < 'purchase' then "deviceId" end as auseraid,
           case when event_type < 'purchase' then floor(value)
                when value >= 50 then value end as avalue
    from ({EVENT_POINTS})"""


@registered("csv_series", _CSV_ROWS)
def csv_series(spark, sf_dir):
    return read_csv_series(spark, _csv_files(spark, sf_dir), _OPTIONS)


@registered("csv_points", f"""
    with wide as ({_CSV_ROWS})
    select "time", "deviceId", 'anumber' as field, anumber as v_long,
           cast(null as double) as v_double, cast(null as varchar) as v_text
    from wide where anumber is not null
    union all
    select "time", "deviceId", 'auseraid', null, null, auseraid
    from wide where auseraid is not null
    union all
    select "time", "deviceId", 'avalue', null, avalue, null
    from wide where avalue is not null""")
def csv_points(spark, sf_dir):
    return read_csv_points(spark, _csv_files(spark, sf_dir), _OPTIONS, merged=True)


@registered("csv_schema", """
    select 'anumber' as field, 1 as type_rank, 8 as "precision", 'bigint' as "type" from events
    union select 'auseraid', 3, 8, 'string' from events
    union select 'avalue', 2, 8, 'double' from events""")
def csv_schema(spark, sf_dir):
    lines = read_lines(spark, _csv_files(spark, sf_dir))
    columns = infer_file_schemas(lines, read_headers(lines, _OPTIONS), _OPTIONS)
    return with_type_name(merge_schemas(columns.select("field", "type_rank", "precision")))


@registered("csv_catalog", f"""
    select "time", 'root.a' || event_type as "deviceId",
           case when event_type >= 'purchase' then cast(event_id as double) end as anumber,
           case when event_type < 'purchase' then "deviceId" end as auseraid,
           case when event_type < 'purchase' then cast(floor(value) as bigint) :: varchar
                when value >= 50 then value :: varchar end as avalue
    from ({EVENT_POINTS})""")
def csv_catalog(spark, sf_dir):
    """Types come from a catalog file: numbers are declared FLOAT and values TEXT."""
    path = new_path(spark, "catalog")
    names = table(spark, sf_dir, "events").select("event_type").distinct()
    names = names.select(F.concat(F.lit("root."), F.col("event_type")).alias("device"))
    kinds = F.array(
        F.struct(F.lit("value").alias("f"), F.lit("TEXT").alias("t")),
        F.struct(F.lit("number").alias("f"), F.lit("FLOAT").alias("t")),
        F.struct(F.lit("user-id").alias("f"), F.lit("TEXT").alias("t")),
    )
    catalog = names.select("device", F.explode(kinds).alias("k")).select(
        "device", F.concat_ws(".", "device", "k.f").alias("series"),
        F.lit("").alias("alias"), F.lit("db").alias("storage"), F.col("k.t").alias("type"),
    )
    catalog.write.option("header", True).csv(path)
    return read_csv_series(
        spark, _csv_files(spark, sf_dir), _OPTIONS, catalog=read_type_catalog(spark, path)
    )


@registered("line_numbers", "select event_id, cast(0 as bigint) as drift from events")
def line_numbers(spark, sf_dir):
    """Lines written in event order: a number and its event move in step within a file."""
    path = new_path(spark, "lines")
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string"))
    write_text(events, path)
    numbered = number_lines(read_lines(spark, path)).select(
        "file", F.col("value").cast("bigint").alias("event_id"), "line_no"
    )
    firsts = numbered.groupBy("file").agg(F.min("event_id").alias("first"))
    drift = F.col("event_id") - F.col("first") + 1 - F.col("line_no")
    return numbered.join(firsts, "file").select("event_id", drift.alias("drift"))


@registered("geolife", f"""
    select "time" // 1000 * 1000 as "time",
           'root.group_0.d_track=' || event_type as "deviceId", value as "Latitude",
           cast(event_id as double) as "Longitude", 0.0 :: double as "Zero",
           cast(user_id as double) as "Altitude"
    from (select e.*, x.user_id from ({EVENT_POINTS}) e join events x using (event_id))""")
def geolife(spark, sf_dir):
    path = new_path(spark, "geolife")
    events = table(spark, sf_dir, "events")
    line = F.concat_ws(
        ",", F.col("value").cast("string"), F.col("event_id").cast("string"), F.lit("0"),
        F.col("user_id").cast("string"), F.lit("39744.12"),
        F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"),
    )
    tracks = events.select(
        line.alias("value"), F.col("event_type").alias("track"), F.lit(1).alias("Trajectory")
    )
    tracks.write.partitionBy("track", "Trajectory").text(path)
    return read_geolife(spark, path)


@registered("noaa", """
    select epoch_us(l_shipdate) // 1000 + 2209046400000 as "time",
           'root.group_0.d_' || l_suppkey || '_99999' as "deviceId",
           l_quantity as "TEMP", l_quantity as "DEWP", l_tax as "SLP", 9999.9 :: double as "STP",
           l_discount as "VISIB", l_tax as "WDSP", l_tax as "MXSPD", 999.9 :: double as "GUST",
           l_quantity as "MAX", -l_quantity as "MIN", 99.99 :: double as "PRCP",
           999.9 :: double as "SNDP", 1000.0 :: double as "FRSHTT"
    from lineitem""")
def noaa(spark, sf_dir):
    path = new_path(spark, "noaa")

    def put(column, width):
        return F.lpad(column.cast("string"), width, " ")

    def text(value, width):
        return F.lpad(F.lit(value), width, " ")

    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    day = F.date_format("l_shipdate", "yyyyMMdd")
    record = F.concat(
        F.rpad(F.col("l_suppkey").cast("string"), 6, " "), F.lit(" 99999  "), day, F.lit("  "),
        put(q, 6), F.lit("  7  "), put(q, 6), F.lit("  7  "), put(t, 6), F.lit("  7  "),
        text("9999.9", 6), F.lit("  0  "), put(d, 5), F.lit("  7  "), put(t, 5), F.lit("  7  "),
        put(t, 5), F.lit("  "), text("999.9", 5), F.lit("  "), put(q, 6), F.lit("* "),
        put(-q, 6), F.lit("* "), text("99.99", 5), F.lit("  "), text("999.9", 5), F.lit("  "),
        F.lit("001000"),
    )
    write_text(table(spark, sf_dir, "lineitem").select(record.alias("value")), path)
    return read_noaa(spark, path, device_from="line")


@registered("tdrive", f"""
    select "time" // 1000 * 1000 as "time", replace("deviceId", 'root.u', 'root.group_0.d_')
           as "deviceId", value as longitude, cast(event_id as double) as latitude
    from ({EVENT_POINTS})""")
def tdrive(spark, sf_dir):
    path = new_path(spark, "tdrive")
    line = F.concat_ws(
        ",", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.col("value").cast("string"), F.col("event_id").cast("string"),
    )
    write_text(table(spark, sf_dir, "events").select(line.alias("value")), path)
    return read_tdrive(spark, path, device_from="column")


@registered("redd", f"""
    select "time" // 1000 * 1000 as "time", 'root.group_0.d_meter=' || event_type as "deviceId",
           value from ({EVENT_POINTS})""")
def redd(spark, sf_dir):
    path = new_path(spark, "redd")
    seconds = F.expr("time div 1000").cast("string")
    lines = event_points(spark, sf_dir).select(
        F.concat_ws(" ", seconds, F.col("value").cast("string")).alias("value"),
        F.col("event_type").alias("meter"),
    )
    lines.write.partitionBy("meter").text(path)
    readings = read_redd(spark, path)
    # The rest of the device name is the name Spark gave to the file.
    device = F.regexp_extract("deviceId", "^(.*?)_part-", 1)
    return readings.select("time", device.alias("deviceId"), "value")


@registered("mlab_utilization", f"""
    with points as ({EVENT_POINTS})
    select "time", event_type || '.' || "deviceId" || ',exp' as "deviceId", value from points
    union all
    select "time" + 1, event_type || '.' || "deviceId" || ',exp', cast(event_id as double)
    from points""")
def mlab_utilization(spark, sf_dir):
    path = new_path(spark, "mlab")

    def sample(time, value):
        return F.struct(time.alias("timestamp"), value.alias("value"))

    message = F.struct(
        F.col("event_type").alias("metric"), F.col("deviceId").alias("hostname"),
        F.lit("exp").alias("experiment"),
        F.array(
            sample(F.col("time"), F.col("value")),
            sample(F.col("time") + 1, F.col("event_id").cast("double")),
        ).alias("sample"),
    )
    write_text(event_points(spark, sf_dir).select(F.to_json(message).alias("value")), path)
    return read_mlab_utilization(spark, path)


def _client_files(spark, sf_dir) -> str:
    path = new_path(spark, "clients")
    events = event_points(spark, sf_dir)
    client = F.struct(
        F.col("deviceId").alias("real_address"), F.col("time").alias("timestamp"),
        F.col("value").alias("connect_time"),
    )
    shapes = {
        "dash": (F.col("event_type").isin("click", "error"),
                 F.struct(F.array(client, client).alias("client"))),
        "raw": (F.col("event_type").isin("purchase", "signup"), F.struct(
            F.struct(F.col("deviceId").alias("myname"), F.col("value").alias("connect_time"))
            .alias("client"),
            F.struct(F.col("time").alias("timestamp")).alias("server"),
        )),
        "flat": (F.col("event_type") == "view", client),
    }
    for name, (rows, message) in shapes.items():
        lines = events.where(rows).select(F.to_json(message).alias("value"))
        write_text(lines, f"{path}/{name}")
    return path


@registered("mlab_ip", f"""
    with points as ({EVENT_POINTS})
    select "time", "deviceId", value as connect_time from points
    union all
    select "time", "deviceId", value from points where event_type in ('click', 'error')""")
def mlab_ip(spark, sf_dir):
    return read_mlab_ip(spark, _client_files(spark, sf_dir))


@registered("mlab_client_count", """
    select case when event_type in ('click', 'error') then 'dash'
                when event_type = 'view' then 'flat' else 'raw' end as shape,
           cast(sum(case when event_type in ('click', 'error') then 2 else 1 end) as bigint)
           as records
    from events group by 1""")
def mlab_client_count(spark, sf_dir):
    counts = count_mlab_clients(spark, _client_files(spark, sf_dir))
    shape = F.regexp_extract("file", "/(dash|raw|flat)/[^/]*$", 1)
    return counts.groupBy(shape.alias("shape")).agg(F.sum("records").alias("records"))


@registered("sink_by_chunk", f"""
    select "time" // 604800000 * 604800000 as time_chunk, count(*) as records,
           count(distinct "deviceId") as devices, min("time") as first_time,
           max(value) as top_value
    from ({EVENT_POINTS}) group by 1""")
def sink_by_chunk(spark, sf_dir):
    path = new_path(spark, "by-chunk")
    write_table(event_points(spark, sf_dir), path, "parquet", "chunk")
    return spark.read.parquet(path).groupBy("time_chunk").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("deviceId").alias("devices"),
        F.min("time").alias("first_time"), F.max("value").alias("top_value"),
    )


@registered("sink_by_device", f"""
    select "deviceId", count(*) as records, min("time") as first_time, max(value) as top_value
    from (select 'root.' || event_type as "deviceId", "time", value from ({EVENT_POINTS}))
    group by 1""")
def sink_by_device(spark, sf_dir):
    path = new_path(spark, "by-device")
    points = event_points(spark, sf_dir).select(
        "time", F.concat(F.lit("root."), F.col("event_type")).alias("deviceId"), "value"
    )
    write_table(points, path, "orc", "device")
    return spark.read.orc(path).groupBy("deviceId").agg(
        F.count(F.lit(1)).alias("records"), F.min("time").alias("first_time"),
        F.max("value").alias("top_value"),
    )


@registered("sink_parts", "select * from orders")
def sink_parts(spark, sf_dir):
    path = new_path(spark, "parts")
    parts = write_parts(
        table(spark, sf_dir, "orders"), path, max_fields=2, keys=["o_orderkey"]
    )
    return read_parts(spark, parts, ["o_orderkey"])


@registered("time_chunks", f"""
    select event_id, "time" // 604800000 * 604800000 as time_chunk from ({EVENT_POINTS})""")
def time_chunks(spark, sf_dir):
    return with_time_chunk(event_points(spark, sf_dir)).select("event_id", "time_chunk")


@registered("sink_by_padded_device", f"""
    select "time", '00' || (event_id % 5) as "deviceId", value from ({EVENT_POINTS})""")
def sink_by_padded_device(spark, sf_dir):
    """Devices that look like numbers keep their names as folders."""
    path = new_path(spark, "by-padded-device")
    device = F.concat(F.lit("00"), (F.col("event_id") % 5).cast("string"))
    points = event_points(spark, sf_dir).select("time", device.alias("deviceId"), "value")
    write_table(points, path, "parquet", "device")
    return scan_parquet(spark, path, ["value"])


@registered("output_size", """
    select true as has_files, true as has_bytes, true as megabytes_match from events limit 1""")
def size_of_output(spark, sf_dir):
    path = new_path(spark, "size")
    write_table(event_points(spark, sf_dir), path, "parquet", "single")
    return output_size(spark, path).select(
        (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"),
        (F.col("megabytes") * 1024 * 1024 == F.col("bytes")).alias("megabytes_match"),
    )
