import math

import pytest
from pyspark.sql import functions as F

from sparkseries.operators import (
    align_long_query,
    align_query,
    apply_schema,
    batch_latency,
    count_query,
    count_range,
    downsample,
    jitter_time,
    keep_last,
    latency_report,
    load_report,
    long_to_wide,
    null_skip,
    raw_query,
    rejoin,
    result_size,
    shuffle_batches,
    sparse_rows,
    split_by_id,
    union_tables,
    vertical_split,
    wide_to_long,
    wide_to_typed_long,
)
from sparkseries.sinks import (
    TIME_CHUNK_MS,
    json_points,
    line_protocol,
    metric_points,
    read_parts,
    record_payload,
    write_discard,
    write_parts,
    write_table,
)
from sparkseries.sources import generate_wide, scan_orc, scan_parquet
from sparkseries.types import NOAA_FIELDS, double_schema

WIDE = "time long, deviceId string, a long, b double, c string"
DATA = [
    (1, "d1", 1, 0.5, "x"), (2, "d1", None, None, None), (3, "d1", None, math.nan, None),
    (11, "d1", 4, None, 'say "hi"'), (25, "d1", 5, 1.0, None), (2, "d2", 6, None, None),
]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(DATA, WIDE).cache()


class Row(tuple):
    """A row in which NaN equals NaN."""

    def __eq__(self, other):
        return repr(tuple(self)) == repr(tuple(other))


def rows(df):
    return sorted((Row(r) for r in df.collect()), key=repr)


def test_raw_query(wide):
    assert rows(raw_query(wide, "a", 2, device="d1")) == [(1, 1), (11, 4)]
    assert rows(raw_query(wide, "a", 2, device="d1", include_null=True)) == [(1, 1), (2, None)]
    assert rows(raw_query(wide, "a", 1)) == [("d1", 1, 1), ("d2", 2, 6)]


def test_align(wide):
    got = rows(align_query(wide, ["a", "b"], device="d1").select("time", "a"))
    assert got == [(1, 1), (11, 4), (25, 5), (3, None)]
    long = wide_to_long(wide.select("time", "deviceId", F.col("a").cast("double"), "b"))
    aligned = align_long_query(long, ["a", "b"], device="d1")
    assert aligned.columns == ["time", "a", "b"]
    assert [r[0] for r in aligned.orderBy("time").collect()] == [1, 3, 11, 25]


def test_counts(wide):
    assert rows(count_query(wide, "a", 11, device="d1")) == [(2,)]
    assert rows(count_query(wide, "a", 11)) == [("d1", 2), ("d2", 1)]
    assert rows(count_range(wide, "a", device="d1")) == [(3,)]
    assert rows(count_range(wide, "a", 2, 11, device="d1")) == [(1,)]


def test_downsample(wide):
    sparse = rows(downsample(wide, "a", 0, 30, 10, device="d1"))
    assert sparse == [(0, 1), (10, 1), (20, 1)]
    # Half open, and aligned with the epoch whatever the start is.
    assert rows(downsample(wide, "a", 1, 25, 10, device="d1")) == [(0, 1), (10, 1)]
    assert rows(downsample(wide, "a", 1, 30, 10, device="d1", origin=1)) == [
        (1, 1), (11, 1), (21, 1)]


@pytest.mark.parametrize("width", [1, 4, 10])
@pytest.mark.parametrize("options", [{}, {"device": "d1"}, {"origin": 3}, {"tag": None}])
def test_filled_and_sparse_agree(wide, width, options):
    sparse = downsample(wide, "a", 2, 26, width, **options)
    filled = downsample(wide, "a", 2, 26, width, fill=True, **options)
    assert rows(filled.where("points > 0")) == rows(sparse.where("points > 0"))
    first = 2 - (2 - options.get("origin", 0)) % width
    buckets = sorted({r.bucket for r in filled.collect()})
    assert buckets == list(range(first, 26, width))
    whole = count_range(wide, "a", 2, 25, **{k: v for k, v in options.items() if k != "origin"})
    assert sum(r.points for r in sparse.collect()) == sum(r.points for r in whole.collect())


def test_filling_has_no_limit(wide):
    grid = downsample(wide, "a", 0, 3_000_000_000, 1, device="d1", fill=True)
    assert grid.columns == ["bucket", "points"]


def test_result_size(wide):
    got = result_size(raw_query(wide, "a", 3, device="d1")).first()
    assert (got.lines, got.points, got.cells) == (3, 3, 6)
    assert got.characters == sum(
        len('{"time":%d,"a":%d}' % r) for r in [(1, 1), (11, 4), (25, 5)])


def test_keep_last(spark):
    df = spark.createDataFrame(
        [(1, "d", 1, "old"), (1, "d", 2, "new"), (2, "d", 1, "only")],
        "time long, deviceId string, version int, v string")
    assert rows(keep_last(df, "version").select("time", "v")) == [(1, "new"), (2, "only")]


def test_layout_round_trips(wide):
    doubles = wide.select("time", "deviceId", F.col("a").cast("double"), "b")
    back = long_to_wide(wide_to_long(doubles), ["a", "b"]).select(doubles.columns)
    assert rows(back) == rows(null_skip(doubles, ["a", "b"]))
    typed = wide_to_typed_long(wide)
    assert typed.count() == 4 + 3 + 2
    assert rows(typed.where("field = 'c'")) == [
        ("d1", 1, "c", None, None, "x"), ("d1", 11, "c", None, None, 'say "hi"')]
    parts = vertical_split(wide, max_fields=2, name="root.d")
    assert {n: p.columns for n, p in parts.items()} == {
        "root.d_1": ["time", "deviceId", "a", "b"], "root.d_2": ["time", "deviceId", "c"]}
    assert rows(rejoin(parts)) == rows(wide)
    assert [r.names for r in sparse_rows(wide).orderBy("deviceId", "time").collect()] == [
        ["a", "b", "c"], ["b"], ["a", "c"], ["a", "b"], ["a"]]


def test_schemas(wide, spark):
    other = spark.createDataFrame([(1, "d3", 2.5, "7")], "time long, deviceId string, a double, z string")
    both = union_tables(wide, other)
    assert dict(both.dtypes)["a"] == "double"
    assert both.where("deviceId = 'd3'").first().asDict() == {
        "time": 1, "deviceId": "d3", "a": 2.5, "b": None, "c": None, "z": "7"}
    shaped = apply_schema(wide, double_schema(NOAA_FIELDS))
    assert shaped.columns == ["time", "deviceId", *NOAA_FIELDS]
    assert shaped.schema["PRCP"].metadata == {"precision": 2}


def test_union_keeps_types_that_all_share(spark):
    one = spark.sql("select 1L as time, 'd' as deviceId, true as flag, 1.50BD as price, 1 as n")
    two = spark.sql("select 2L as time, 'd' as deviceId, false as flag, 2.5D as n")
    both = union_tables(one, two)
    assert dict(both.dtypes) == {
        "time": "bigint", "deviceId": "string", "flag": "boolean", "price": "decimal(3,2)", "n": "double"}
    with pytest.raises(ValueError, match="flag"):
        union_tables(one, two.withColumn("flag", F.lit("yes")))


def test_rejoin_refuses_repeated_keys(spark):
    rows = [(1, "a", 1, 2), (None, "a", 3, None), (None, None, 5, 6)]
    df = spark.createDataFrame(rows, "time long, deviceId string, `a b` int, c int")
    parts = vertical_split(df, max_fields=1)
    back = rejoin(parts)
    assert back.columns == df.columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    twice = vertical_split(df.union(df.limit(1)), max_fields=1)
    with pytest.raises(Exception, match="a key repeats"):
        rejoin(twice).collect()


def test_transforms(wide, spark):
    assert jitter_time(wide) is wide
    series = spark.range(2000).select(F.col("id").alias("time"))
    moved = jitter_time(series, 50.0, seed=1)
    assert rows(moved) != rows(series)
    assert rows(moved) == rows(jitter_time(series.repartition(7), 50.0, seed=1))
    assert abs(moved.agg(F.avg("time")).first()[0] - 999.5) < 10
    amounts = spark.range(20000).select(F.lit(0).cast("long").alias("time"), "id")
    spread = jitter_time(amounts, 1000.0).agg(F.stddev("time")).first()[0]
    assert 970 < spread < 1030
    batches = spark.range(5000).select("id", F.expr("id div 100").alias("batch"))
    mixed = [r.id for r in shuffle_batches(batches, "batch", "id", share=0.5).collect()]
    assert sorted(mixed) == list(range(5000)) and mixed != list(range(5000))
    kept = [mixed[i : i + 100] == list(range(i, i + 100)) for i in range(0, 5000, 100)]
    assert 10 < sum(kept) < 40
    ids = spark.createDataFrame([("d2",), ("d2",), ("d9",)], "deviceId string")
    assert rows(split_by_id(wide, ids, "deviceId").select("time", "a")) == [(2, 6)]


def test_load_report(wide):
    report = load_report(wide, file=F.col("deviceId"), batch_rows=2, elapsed_ms=500).first()
    assert report.asDict() == {
        "files": 2, "records": 6, "points": 18, "present_points": 9, "batches": 4,
        "points_per_s": 36.0}


def test_batch_latency(spark):
    df = spark.createDataFrame([(i, i * 1e6) for i in range(1, 11)], "n long, ns double")
    got = batch_latency(df, "ns", ["n"], last=4).first()
    assert (got.avg_all_ms, got.avg_last_ms, got.n_last) == (5.5, 8.5, 4)


def test_latency_report(spark):
    line = '[INFO ] main:37 - Exp:"E_%d" done! Query Param:%d. query time: %s ms'
    texts = ["start", line % (10, 10, "1.5"), line % (100, 100, "7"), line % (10, 10, "2.5"),
             "done! Query Param:10 without the dot 9 ms"]
    log = spark.createDataFrame(list(enumerate(texts)), "line_no int, value string")
    assert rows(latency_report(log, ["line_no"])) == [
        (10, 1, 1.5, 2.0), (10, 2, 2.5, 2.0), (100, 1, 7.0, 7.0)
    ]
    report = latency_report(log, ["line_no"], repeats=2)
    assert report.columns == ["query_parameter", "repeat1", "repeat2", "average_ms"]
    assert rows(report) == [(10, 1.5, 2.5, 2.0), (100, 7.0, None, 7.0)]
    assert len(latency_report(log, ["line_no"], [10], repeats=6).columns) == 8


def test_payloads_of_odd_values(spark):
    import json

    rows = [(1, "d 1,x=y\n", float("nan"), "two\nlines \\", 1), (2, None, 2.0, None, None),
            (3, "e", float("inf"), None, None), (4, "e", float("-inf"), None, 7), (5, "e", None, None, None)]
    df = spark.createDataFrame(rows, "time long, deviceId string, `a b,c=d` double, s string, n long")
    lines = sorted(r[0] for r in line_protocol(df, measurement="my tb").collect())
    assert lines == [
        "my\\ tb a\\ b\\,c\\=d=2.0 2000000",
        'my\\ tb,deviceId=d\\ 1\\,x\\=y\\n s="two\\nlines \\\\",n=1i 1000000',
        "my\\ tb,deviceId=e n=7i 4000000",
    ]
    strict = {"parse_constant": lambda c: pytest.fail(c)}
    single = [json.loads(r[0], **strict) for r in json_points(df, batched=False).collect()]
    assert sorted((p["name"], p["timestamp"]) for p in single) == [("a b,c=d", 2), ("n", 1), ("n", 4), ("s", 1)]
    assert {p["timestamp"]: p["tags"]["deviceId"] for p in single} == {1: "d 1,x=y\n", 2: None, 4: "e"}
    batches = [json.loads(r[0], **strict) for r in json_points(df).collect()]
    assert sum(len(b["datapoints"]) for b in batches) == 4
    assert len([json.loads(r[0], **strict) for r in metric_points(df).collect()]) == 4


def test_payloads(wide):
    lines = [r[0] for r in line_protocol(wide).orderBy("value").collect()]
    assert len(lines) == 4  # the record that holds only a NaN has no message
    assert lines[0] == 'tb1,deviceId=d1 a=1i,b=0.5,c="x" 1000000'
    assert 'c="say \\"hi\\"" 11000000' in lines[1]
    batch = [r[0] for r in json_points(wide, ["a", "c"]).orderBy("value").collect()]
    assert batch[0] == '{"name":"a","tags":{"deviceId":"d1"},"datapoints":[[1,1],[11,4],[25,5]]}'
    assert batch[2] == ('{"name":"c","tags":{"deviceId":"d1"},"datapoints":'
                        '[[1,"\\"x\\""],[11,"\\"say \\"hi\\"\\""]]}').replace(
                            '\\"say \\"hi\\"\\"', '\\"say \\"hi\\"\\"')
    single = [r[0] for r in json_points(wide, ["b"], batched=False).collect()]
    assert '{"name":"b","tags":{"deviceId":"d1"},"timestamp":1,"value":0.5}' in single
    metric = [r[0] for r in metric_points(wide, ["a"]).collect()]
    assert '{"metric":"a","timestamp":25,"value":5,"tags":{"deviceId":"d1"}}' in metric
    assert record_payload(wide).count() == 5


@pytest.mark.parametrize("file_format", ["parquet", "orc"])
@pytest.mark.parametrize("layout", ["device", "chunk", "single"])
def test_tables(spark, wide, tmp_path, file_format, layout):
    path = str(tmp_path / "t")
    for _ in range(2):
        write_table(wide, path, file_format, layout)
    stored = spark.read.format(file_format).load(path)
    assert rows(stored.select(wide.columns)) == rows(wide)
    write_table(wide, path, file_format, layout, mode="append")
    assert spark.read.format(file_format).load(path).count() == 2 * len(DATA)
    scan = scan_parquet if file_format == "parquet" else scan_orc
    assert scan(spark, path, ["a"], 2, 11, device="d1").count() == 6
    assert scan(spark, path, ["a"], suffix="2").count() == 2


def test_scans_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(generate_wide(spark, 100, 50).withColumn(
        "time", F.col("time") * TIME_CHUNK_MS), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    start, end = TIME_CHUNK_MS, 3 * TIME_CHUNK_MS
    scan = scan_parquet(spark, path, ["s1"], start, end, device="device", chunk=TIME_CHUNK_MS)
    text = scan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<time:bigint,deviceId:string,s1:double>" in text
    assert "EqualTo(deviceId,device)" in text
    assert f"GreaterThanOrEqual(time,{start})" in text
    assert f"LessThanOrEqual(time,{end})" in text
    partitions = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "time_chunk" in partitions and ">=" in partitions and "<=" in partitions
    assert scan.count() == 3 and len(scan.inputFiles()) >= 3


def test_parts_and_discard(spark, wide, tmp_path):
    paths = write_parts(wide, str(tmp_path / "p"), "root.d", max_fields=1)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["root.d_1", "root.d_2", "root.d_3"]
    assert rows(read_parts(spark, paths)) == rows(wide)
    write_discard(wide)
