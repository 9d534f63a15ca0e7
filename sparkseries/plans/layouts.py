"""Layouts, payloads, schemas, names, values and dataset transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    cut_position,
    device_part,
    epoch_ms,
    field_part,
    file_stem,
    ms_to_ns,
    normalize_name,
    parent_of,
    parse_time,
    quote_text,
    safe_parse,
    seconds_to_ms,
    sql_escape_text,
    strip_outer_quotes,
)
from ..operators import (
    extend_series,
    group_points,
    infer_column_types,
    jitter_time,
    merge_schemas,
    points,
    rejoin,
    shuffle_batches,
    sparse_rows,
    split_by_id,
    union_tables,
    vertical_split,
    wide_to_long,
    wide_to_typed_long,
    with_type_name,
)
from ..operators.layout import long_to_wide
from ..sinks import json_points, line_protocol, metric_points, record_payload
from .registry import EVENT_POINTS, event_points, registered, table
from .series import SENSORS


@registered("wide_to_long", " union all ".join(
    f"select l_suppkey, l_shipdate, '{s}' as field, {s} as value from lineitem "
    f"where {s} is not null" for s in SENSORS))
def to_long(spark, sf_dir):
    return wide_to_long(table(spark, sf_dir, "lineitem"), SENSORS, "l_shipdate", "l_suppkey")


@registered("wide_to_typed_long", """
    select o_custkey, o_orderdate, 'o_orderkey' as field, o_orderkey as v_long,
           cast(null as double) as v_double, cast(null as varchar) as v_text from orders
    union all
    select o_custkey, o_orderdate, 'o_totalprice', null, o_totalprice, null from orders
    union all
    select o_custkey, o_orderdate, 'o_orderstatus', null, null, o_orderstatus from orders
    where o_orderstatus <> 'F'""")
def to_typed_long(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderstatus", F.nullif("o_orderstatus", F.lit("F"))
    )
    return wide_to_typed_long(
        orders, ["o_orderkey", "o_totalprice", "o_orderstatus"], "o_orderdate", "o_custkey"
    )


@registered("long_to_wide", """
    select l_suppkey, l_shipdate, max(l_quantity) as l_quantity,
           max(l_extendedprice) as l_extendedprice, max(l_discount) as l_discount,
           max(l_tax) as l_tax
    from lineitem group by l_suppkey, l_shipdate""")
def back_to_wide(spark, sf_dir):
    long = wide_to_long(table(spark, sf_dir, "lineitem"), SENSORS, "l_shipdate", "l_suppkey")
    return long_to_wide(long, SENSORS, "l_shipdate", "l_suppkey")


@registered("points", f"""
    select event_type as "name", "deviceId" as device, "time" as "timestamp", value
    from ({EVENT_POINTS}) where value is not null""")
def as_points(spark, sf_dir):
    long = event_points(spark, sf_dir).withColumnRenamed("event_type", "field")
    return points(long).select(
        "name", F.col("tags")["deviceId"].alias("device"), "timestamp", "value"
    )


@registered("group_points", f"""
    with numbered as (
        select *, row_number() over (partition by "deviceId", event_type
                                     order by "time", value) as n
        from ({EVENT_POINTS}))
    select "deviceId", event_type as field, (n - 1) // 5 as batch, count(*) as n_points,
           string_agg("time" || ':' || value, ' ' order by n) as datapoints
    from numbered group by 1, 2, 3""")
def grouped_points(spark, sf_dir):
    long = event_points(spark, sf_dir).withColumnRenamed("event_type", "field")
    text = F.transform(
        "datapoints", lambda p: F.concat_ws(":", p["t"].cast("string"), p["v"].cast("string"))
    )
    return group_points(long, batch_points=5).select(
        "deviceId", "field", "batch", F.size("datapoints").cast("bigint").alias("n_points"),
        F.concat_ws(" ", text).alias("datapoints"),
    )


@registered("sparse_rows", f"""
    select "deviceId", "time",
           concat_ws(',', 'event_id', case when event_type <> 'view' then 'event_type' end,
                     case when value >= 50 then 'value' end) as names,
           concat_ws(',', 'bigint', case when event_type <> 'view' then 'string' end,
                     case when value >= 50 then 'double' end) as types,
           concat_ws(',', event_id, case when event_type <> 'view' then event_type end,
                     case when value >= 50 then value end) as "values"
    from ({EVENT_POINTS})""")
def sparse(spark, sf_dir):
    rows = event_points(spark, sf_dir).select(
        "time", "deviceId", "event_id",
        F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.when(F.col("value") >= 50, F.col("value")).alias("value"),
    )
    return sparse_rows(rows).select(
        "deviceId", "time", *[F.concat_ws(",", c).alias(c) for c in ("names", "types", "values")]
    )


@registered("vertical_split_join", "select * from orders")
def split_and_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = vertical_split(orders, ["o_orderkey"], max_fields=2, name="orders")
    return rejoin(parts, ["o_orderkey"])


@registered("union_tables", """
    select ts as "time", user_id as "deviceId", value, event_id as number,
           cast(null as varchar) as status from events
    union all
    select o_orderdate, o_custkey, null, o_totalprice, o_orderstatus from orders""")
def united(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("ts").alias("time"), F.col("user_id").alias("deviceId"), "value",
        F.col("event_id").alias("number"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("time"), F.col("o_custkey").alias("deviceId"),
        F.col("o_totalprice").alias("number"), F.col("o_orderstatus").alias("status"),
    )
    return union_tables(events, orders)


_RANK = """max(case when {c} = '' or lower({c}) = 'null' then null
    when regexp_full_match({c}, '[+-]?[0-9]+') and try_cast({c} as bigint) is not null then 1
    when try_cast({c} as double) is not null then 2 else 3 end)"""


def _rank_sql(name: str, column: str, source: str) -> str:
    rank = _RANK.format(c=f"cast({column} as varchar)")
    return f"select '{name}' as field, cast({rank} as integer) as type_rank from {source}"


@registered("infer_types", """
    with ranks as (%s)
    select field, type_rank,
           case coalesce(type_rank, 3) when 1 then 'bigint' when 2 then 'double' else 'string'
           end as "type" from ranks""" % " union all ".join([
    _rank_sql("k", "json_extract(props, '$.k')", "events"),
    _rank_sql("event_type", "event_type", "events"),
    _rank_sql("value", "value", "events"),
    _rank_sql("quoted", "'\"' || event_id || '\"'", "events"),
    "select 'empty' as field, cast(null as integer) as type_rank",
]))
def inferred(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cells = events.select(
        F.get_json_object("props", "$.k").alias("k"), "event_type",
        F.col("value").cast("string").alias("value"),
        quote_text(F.col("event_id").cast("string")).alias("quoted"),
        F.lit("").alias("empty"),
    )
    return with_type_name(infer_column_types(cells))


@registered("merge_schemas", """
    with ranks as (%s)
    select field, cast(max(type_rank) as integer) as type_rank, 8 as "precision"
    from ranks group by field""" % " union all ".join([
    _rank_sql("number", "event_id", "events"), _rank_sql("text", "event_type", "events"),
    _rank_sql("number", "o_totalprice", "orders"), _rank_sql("status", "o_orderkey", "orders"),
]))
def merged(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("number"), F.col("event_type").alias("text")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_totalprice").cast("string").alias("number"),
        F.col("o_orderkey").cast("string").alias("status"),
    )
    return merge_schemas(infer_column_types(events), infer_column_types(orders))


@registered("normalize_names", r"""
    select page_id, array_to_string(list_transform(
        string_split(regexp_replace(regexp_replace(url, '[()@%\-]', 'a', 'g'), '\.+$', ''), '.'),
        lambda p: case when p = 'root' then p else 'a' || p end), '.') as "name"
    from pages""")
def normalized(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", normalize_name(F.col("url")).alias("name")
    )


@registered("series_names", r"""
    with series as (
        select page_id, case when page_id % 3 = 0 then replace(url, '.', '-') else url end as "name"
        from pages)
    select page_id, case when "name" like '%.%' then regexp_extract("name", '^(.*)\.[^.]*$', 1)
                         else regexp_extract("name", '([^/]*)$', 1) end as device,
           regexp_extract("name", '([^.]*)$', 1) as field from series""")
def series_names(spark, sf_dir):
    """A name without a dot has no device of its own and takes that of its file."""
    name = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("."), F.lit("-"))).otherwise(F.col("url"))
    series = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    cut = cut_position(F.col("name"))
    device = F.coalesce(device_part(F.col("name"), cut), file_stem(F.col("name")))
    return series.select("page_id", device.alias("device"), field_part(F.col("name"), cut).alias("field"))


@registered("path_parts", r"""
    select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') as stem,
           string_split(url, '/p')[1] as parent from pages""")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", file_stem(F.col("url")).alias("stem"),
        parent_of(F.col("url"), "p").alias("parent"),
    )


@registered("safe_parse", """
    with cells as (
        select event_id, case event_id % 4 when 0 then cast(event_id as varchar)
            when 1 then cast(value as varchar) when 2 then event_type else 'NULL' end as cell
        from events)
    select event_id, case when regexp_full_match(cell, '[+-]?[0-9]+')
               then try_cast(cell as bigint) end as as_long,
           try_cast(cell as double) as as_double,
           case when lower(cell) <> 'null' then cell end as as_text
    from cells""")
def parsed(spark, sf_dir):
    kind = F.col("event_id") % 4
    cell = (
        F.when(kind == 0, F.col("event_id").cast("string"))
        .when(kind == 1, F.col("value").cast("string"))
        .when(kind == 2, F.col("event_type"))
        .otherwise("NULL")
    )
    cells = table(spark, sf_dir, "events").select("event_id", cell.alias("cell"))
    return cells.select(
        "event_id",
        safe_parse(F.col("cell"), "bigint").alias("as_long"),
        safe_parse(F.col("cell"), "double").alias("as_double"),
        safe_parse(F.col("cell"), "string").alias("as_text"),
    )


@registered("strip_quotes", """
    with cells as (
        select doc_id, case doc_id % 3 when 0 then '"' || text || '"'
            when 1 then '''' || text || '''' else '"' || text end as cell from documents)
    select doc_id, case when length(cell) >= 2 and left(cell, 1) = right(cell, 1)
               and left(cell, 1) in ('"', '''') then substring(cell, 2, length(cell) - 2)
           else cell end as "text" from cells""")
def stripped(spark, sf_dir):
    text, kind = F.col("text"), F.col("doc_id") % 3
    cell = (
        F.when(kind == 0, quote_text(text))
        .when(kind == 1, F.concat(F.lit("'"), text, F.lit("'")))
        .otherwise(F.concat(F.lit('"'), text))
    )
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", strip_outer_quotes(cell).alias("text"))


@registered("sql_text", """
    select doc_id, '''' || replace(text, '''', '"') || '''' as literal,
           '"' || text || '"' as quoted from documents""")
def sql_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", sql_escape_text(F.col("text")).alias("literal"),
        quote_text(F.col("text")).alias("quoted"),
    )


@registered("parse_time", """
    select event_id, case when event_id % 3 = 1 then epoch_us(ts) // 1000 - 28800000
                          else epoch_us(ts) // 1000 end as "time" from events""")
def times(spark, sf_dir):
    """The same moments as epoch numbers, as local times with and without an offset."""
    wall = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", wall.alias("iso"), (F.col("event_id") % 3).alias("kind")
    )
    text = (
        F.when(F.col("kind") == 0, epoch_ms(F.col("ts")).cast("string"))
        .when(F.col("kind") == 1, F.concat("iso", F.lit("+08:00")))
        .otherwise(F.col("iso"))
    )
    return events.select("event_id", parse_time(text).alias("time"))


@registered("unit_conversions", f"""
    select event_id, "time" * 1000000 as ns, "time" // 1000 * 1000 as ms
    from ({EVENT_POINTS})""")
def units(spark, sf_dir):
    return event_points(spark, sf_dir).select(
        "event_id", ms_to_ns(F.col("time")).alias("ns"),
        seconds_to_ms(F.expr("time div 1000")).alias("ms"),
    )


@registered("line_protocol", f"""
    select 'tb1,deviceId=' || "deviceId" || ' event_id=' || event_id || 'i,event_type="'
           || event_type || '"' || case when value >= 50 then ',value=' || value else '' end
           || ' ' || ("time" * 1000000) as "value"
    from ({EVENT_POINTS})""")
def lines(spark, sf_dir):
    rows = event_points(spark, sf_dir).withColumn(
        "value", F.when(F.col("value") >= 50, F.col("value"))
    )
    return line_protocol(rows, ["event_id", "event_type", "value"])


@registered("json_points", f"""
    with numbered as (
        select *, row_number() over (partition by "deviceId" order by "time", value) as n
        from ({EVENT_POINTS}))
    select '{{"name":"value","tags":{{"deviceId":"' || "deviceId" || '"}},"datapoints":['
           || string_agg('[' || "time" || ',' || value || ']', ',' order by n) || ']}}' as "value"
    from numbered group by "deviceId", (n - 1) // 50""")
def json_batches(spark, sf_dir):
    return json_points(event_points(spark, sf_dir), ["value"], batch_points=50)


@registered("json_single_points", f"""
    select '{{"name":"event_type","tags":{{"deviceId":"' || "deviceId" || '"}},"timestamp":'
           || "time" || ',"value":"\\"' || event_type || '\\""}}' as "value"
    from ({EVENT_POINTS})""")
def json_singles(spark, sf_dir):
    return json_points(event_points(spark, sf_dir), ["event_type"], batched=False)


@registered("metric_points", f"""
    select '{{"metric":"value","timestamp":' || "time" || ',"value":' || value
           || ',"tags":{{"deviceId":"' || "deviceId" || '"}}}}' as "value"
    from ({EVENT_POINTS})""")
def metrics(spark, sf_dir):
    return metric_points(event_points(spark, sf_dir), ["value"])


@registered("record_payload", f"""
    select '{{"deviceId":"' || "deviceId" || '","time":' || "time"
           || ',"names":["event_id","value"],"types":["bigint","double"],"values":["'
           || event_id || '","' || value || '"]}}' as "value"
    from ({EVENT_POINTS})""")
def record_messages(spark, sf_dir):
    return record_payload(event_points(spark, sf_dir), ["event_id", "value"])


@registered("extend_series", f"""
    with numbered as (
        select "time", "deviceId", value,
               row_number() over (partition by "deviceId" order by "time", value) as n,
               count(*) over (partition by "deviceId") as total,
               max("time") over (partition by "deviceId") as last
        from ({EVENT_POINTS}))
    select "time", "deviceId", value from numbered
    union all
    select last + i * total + n - 1, "deviceId", value
    from numbered, (select unnest(range(4)) as i)""")
def extended(spark, sf_dir):
    return extend_series(event_points(spark, sf_dir).select("time", "deviceId", "value"), 4)


@registered("extend_series_null_device", f"""
    with points as (
        select "time", case when event_id % 7 = 0 then null else "deviceId" end as "deviceId", value
        from ({EVENT_POINTS})),
    numbered as (
        select *, row_number() over (partition by "deviceId" order by "time", value) as n,
               count(*) over (partition by "deviceId") as total,
               max("time") over (partition by "deviceId") as last
        from points)
    select "time", "deviceId", value from numbered
    union all
    select last + i * total + n - 1, "deviceId", value
    from numbered, (select unnest(range(4)) as i)""")
def extended_null_device(spark, sf_dir):
    """Rows without a device are a series like others."""
    points = event_points(spark, sf_dir)
    device = F.when(F.col("event_id") % 7 != 0, F.col("deviceId")).alias("deviceId")
    return extend_series(points.select("time", device, "value"), 4)


@registered("split_by_id", "select * from documents where doc_id in (select doc_id from labels)")
def by_id(spark, sf_dir):
    return split_by_id(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id"
    )


@registered("jitter_time", """
    select event_type, count(*) as points, true as within, true as moved, true as centred
    from events group by event_type""")
def jittered(spark, sf_dir):
    """Facts on the shifts: none beyond nine deviations, not all zero, their mean near zero."""
    points = event_points(spark, sf_dir).select("event_id", "event_type", "time")
    shift = F.col("time") - F.col("was")
    return (
        jitter_time(points.withColumn("was", F.col("time")), 1000.0)
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("points"), F.every(F.abs(shift) <= 9000).alias("within"),
            F.some(shift != 0).alias("moved"), (F.abs(F.avg(shift)) <= 500).alias("centred"),
        )
    )


@registered("shuffle_batches", f"""
    select "time", "deviceId", event_id, value from ({EVENT_POINTS})""")
def shuffled(spark, sf_dir):
    rows = event_points(spark, sf_dir).select("time", "deviceId", "event_id", "value")
    batches = rows.withColumn("batch", F.expr("event_id div 1000"))
    return shuffle_batches(batches, "batch", "event_id").drop("batch")
