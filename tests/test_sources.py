import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkseries.sources import (
    CsvSeries,
    count_mlab_clients,
    generate_wide,
    list_files,
    number_lines,
    read_csv_points,
    read_csv_series,
    read_geolife,
    read_lines,
    read_mlab_ip,
    read_mlab_utilization,
    read_noaa,
    read_redd,
    read_synthetic,
    read_tdrive,
    read_type_catalog,
)
from sparkseries.sources.csv_series import infer_file_schemas, read_headers
from sparkseries.types import NOAA_FIELDS


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_line_numbers_over_small_blocks(spark, write, tmp_path, small_blocks):
    for name in ("a.txt", "b/c.txt"):
        write(name, "".join(f"{name} {i:04d}\n" for i in range(1, 200)) + "\n")
    numbered = number_lines(read_lines(spark, str(tmp_path)))
    assert numbered.select("block").distinct().count() > 5
    got = numbered.select("value", "line_no").collect()
    assert len(got) == 398
    assert all(int(r.value.split()[1]) == r.line_no for r in got)


CSV_A = """Time,root.g.d1.s(1),root.g.d1.s2,root.g.d1.note,root.g.d1.empty
1000,1,2.5,'null',
2000,,NULL,"it's",null
2021-08-05T08:24:36.000+08:00,3
never,4,4,4,

3000,4x,4,5,,
"""
CSV_B = """Time,s(1),extra
5,1.5,"7"
6,2,"8"
"""


def test_csv_series(spark, write, tmp_path):
    write("a.csv", CSV_A)
    write("dev-2.csv", CSV_B)
    wide = read_csv_series(spark, str(tmp_path))
    assert dict(wide.dtypes) == {
        "time": "bigint", "deviceId": "string", "as2": "double", "asa1a": "string",
        "anote": "string", "aempty": "string", "aextra": "string",
    }
    names = ["time", "deviceId", "asa1a", "as2", "anote", "aempty", "aextra"]
    assert rows(wide.select(*names)) == [
        (5, "adeva2", "1.5", None, None, None, "7"),
        (6, "adeva2", "2", None, None, None, "8"),
        (1000, "root.ag.ad1", "1", 2.5, None, None, None),
        (2000, "root.ag.ad1", None, None, "it's", None, None),
        (3000, "root.ag.ad1", "4x", 4.0, "5", None, None),
        (1628123076000, "root.ag.ad1", "3", None, None, None, None),
    ]
    assert wide.schema["as2"].metadata["precision"] == 8


def test_csv_rows_used_for_inference(spark, write, tmp_path, small_blocks):
    """With two rows looked at, s(1) is a long and the later text becomes null."""
    write("a.csv", CSV_A)
    options = CsvSeries(infer_rows=2, normalize=False)
    wide = read_csv_series(spark, str(tmp_path), options)
    assert dict(wide.dtypes)["s(1)"] == "bigint"
    assert [r[0] for r in wide.orderBy("time").select("s(1)").collect()] == [1, None, None, 3]


def test_csv_quotes_are_kept_while_inferring(spark, write, tmp_path):
    write("b.csv", CSV_B)
    lines = read_lines(spark, str(tmp_path))
    ranks = infer_file_schemas(lines, read_headers(lines))
    assert {r.field: r.type_rank for r in ranks.collect()} == {"asa1a": 2, "aextra": 3}


def test_csv_header_that_looks_like_data(spark, write, tmp_path):
    """The header's own cells do not count, whatever their type would be."""
    write("h.csv", "Time,1,2.5,x\n1,10,7,\n2,20,,3\n")
    lines = read_lines(spark, str(tmp_path))
    options = CsvSeries(normalize=False)
    ranks = infer_file_schemas(lines, read_headers(lines, options), options)
    assert {r.pos: r.type_rank for r in ranks.collect()} == {1: 1, 2: 1, 3: 1}


def test_csv_without_series_is_skipped(spark, write, tmp_path):
    write("a.csv", CSV_B)
    write("empty.csv", "Time\n1\n2\n")
    assert read_csv_series(spark, str(tmp_path)).count() == 2


def test_csv_merges_long_and_double_and_ignores_empty_columns(spark, write, tmp_path):
    write("a.csv", "Time,v,w\n1,1,\n2,2,\n")
    write("b.csv", "Time,v,w\n1,1.5,7\n")
    wide = read_csv_series(spark, str(tmp_path), CsvSeries(normalize=False))
    assert dict(wide.dtypes)["v"] == "double"
    assert dict(wide.dtypes)["w"] == "bigint"
    points = read_csv_points(spark, str(tmp_path), CsvSeries(normalize=False))
    assert rows(points) == [
        (1, "a", "v", 1, None, None), (1, "b", "v", None, 1.5, None),
        (1, "b", "w", 7, None, None), (2, "a", "v", 2, None, None),
    ]


def test_csv_separator_is_a_regular_expression(spark, write, tmp_path):
    write("a.csv", "Time|v|w\n1|2|x\n")
    options = CsvSeries(sep="\\|", normalize=False)
    assert rows(read_csv_series(spark, str(tmp_path), options)) == [(1, "a", 2, "x")]


def test_csv_last_of_equal_names_wins(spark, write, tmp_path):
    write("a.csv", "Time,v,v\n1,2,3\n")
    wide = read_csv_series(spark, str(tmp_path), CsvSeries(normalize=False))
    assert rows(wide) == [(1, "a", 3)]


def test_catalog(spark, write, tmp_path):
    write("data/a.csv", "Time,root.d.v,root.d.w\n1,2,3\n2,x,4\n")
    catalog = write("types.csv", "\n".join([
        "no,series,alias,store,type", "1,root.d.v,,g,INT32", "2,root.d.w,,g,DATE",
        "3,root.d.z,,g,FLOAT", "4,root.d.y,,g,BOOLEAN",
    ]))
    types = read_type_catalog(spark, catalog)
    assert {r.series: r.type_rank for r in types.collect()} == {
        "root.d.v": 1, "root.d.w": 3, "root.d.z": 2, "root.d.y": 3}
    wide = read_csv_series(spark, str(tmp_path / "data"), catalog=types)
    assert rows(wide) == [(1, "root.ad", 2, "3"), (2, "root.ad", None, "4")]
    with pytest.raises(PySparkException, match="no declared type for series root.d.v"):
        read_csv_series(spark, str(tmp_path / "data"), catalog=types.where("series <> 'root.d.v'"))


PLT = """Geolife trajectory
WGS 84
Altitude is in Feet
Reserved 3
0,2,255,5,0,0,2,8421376
0
39.98,116.31,0,492,39744.12,2008-10-23,02:53:04
39.99,116.32,0,491,39744.13,2008-10-23,12:53:10
39.99,116.32,0,491
39.99,x,0,491,39744.13,2008-10-23,12:53:10
"""


def test_geolife(spark, write, tmp_path):
    write("d/000/Trajectory/1.plt", PLT)
    root = str(tmp_path / "d")
    device = "root.group_0.d_000"
    assert rows(read_geolife(spark, root)) == [
        (1224730384000, device, 39.98, 116.31, 0.0, 492.0),
        (1224766390000, device, 39.99, 116.32, 0.0, 491.0),
    ]
    noon_as_zero = rows(read_geolife(spark, root, twelve_hours=True))
    assert [r[0] for r in noon_as_zero] == [1224723190000, 1224730384000]
    moved = read_geolife(spark, root, zone="Asia/Shanghai")
    assert [r[0] for r in rows(moved)] == [1224701584000, 1224737590000]


NOAA = (
    "STN--- WBAN   YEARMODA    TEMP       DEWP      SLP        STP       VISIB      WDSP"
    "     MXSPD   GUST    MAX     MIN   PRCP   SNDP   FRSHTT\n"
    "501360 99999  19730101   -33.6  7   -37.7  7  1023.4  7  9999.9  0   11.5  7    0.6  7"
    "    3.9  999.9   -18.4*  -41.8* 99.99  999.9  001000\n"
    "501360 99999  19730102   -33.6  7   -37.7  7  bad.4\n"
)


def test_noaa(spark, write, tmp_path):
    write("d/501360-99999-1973.op", NOAA)
    got = read_noaa(spark, str(tmp_path / "d"))
    assert got.columns == ["time", "deviceId", *NOAA_FIELDS]
    assert rows(got) == [(
        94694400000 + 2209046400000, "root.group_0.d_501360_99999", -33.6, -37.7, 1023.4, 9999.9,
        11.5, 0.6, 3.9, 999.9, -18.4, -41.8, 99.99, 999.9, 1000.0,
    )]
    assert rows(read_noaa(spark, str(tmp_path / "d"), device_from="line")) == rows(got)
    clean = rows(read_noaa(spark, str(tmp_path / "d"), sentinel_to_null=True))[0]
    assert clean[5] is clean[9] is clean[12] is clean[13] is None


def test_tdrive(spark, write, tmp_path):
    write("d/17.txt", "1,2008-02-02 15:36:08,116.5,39.9\n1,2008-02-02 12:00:00,116.5,39.9\nx\n")
    root = str(tmp_path / "d")
    assert rows(read_tdrive(spark, root)) == [
        (1201953600000, "root.group_0.d_17", 116.5, 39.9),
        (1201966568000, "root.group_0.d_17", 116.5, 39.9),
    ]
    assert rows(read_tdrive(spark, root, twelve_hours=True))[0][0] == 1201953600000 - 43200000
    by_column = read_tdrive(spark, root, device_from="column")
    assert {r.deviceId for r in by_column.collect()} == {"root.group_0.d_1"}


def test_redd(spark, write, tmp_path):
    write("low/house_1/channel_2.dat", "1303132929 222.20\n1303132930 223.17\nbad line\n")
    assert rows(read_redd(spark, str(tmp_path / "low"))) == [
        (1303132929000, "root.group_0.d_house_1_channel_2", 222.2),
        (1303132930000, "root.group_0.d_house_1_channel_2", 223.17),
    ]


def test_devices_of_unusual_paths(spark, write, tmp_path, monkeypatch):
    """Folders with signs that Spark encodes, and a root name that comes twice."""
    for house in ("h 1", "h+2%20"):
        write(f"data/{house}/data/c1.dat", "1303132929 222.20\n")
    want = ["root.group_0.d_h 1_data_c1", "root.group_0.d_h+2%20_data_c1"]
    root = str(tmp_path / "data")
    for path in (root, f"file://{root}/"):
        assert sorted(r[1] for r in rows(read_redd(spark, path))) == want
    files = list_files(spark, root)
    assert sorted(f[-13:] for f in files) == ["%20/data/c1.dat"[-13:], "h 1/data/c1.dat"[-13:]]
    assert read_redd(spark, root, files=files[:1]).count() == 1


def test_csv_columns_that_differ_by_case(spark, write, tmp_path):
    write("a.csv", "Time,root.d.Temp,root.d.temp\n1,2,x\n")
    wide = read_csv_series(spark, str(tmp_path), CsvSeries(normalize=False))
    names, row = wide.columns, tuple(wide.collect()[0])
    assert dict(zip(names, row)) == {"time": 1, "deviceId": "root.d", "Temp": 2, "temp": "x"}


def test_mlab_utilization(spark, write, tmp_path):
    write("m.json", "\n".join([
        '{"metric":"m","hostname":"h","experiment":"e",'
        '"sample":[{"timestamp":1,"value":0.5},{"timestamp":2,"value":1}]}',
        '{"metric":"m","hostname":"h","experiment":"e","sample":[]}',
        '{"metric":"m", broken',
    ]))
    assert rows(read_mlab_utilization(spark, str(tmp_path))) == [
        (1, "m.h,e", 0.5), (2, "m.h,e", 1.0)]


def test_mlab_clients(spark, write, tmp_path):
    client = '{"real_address":"%s","timestamp":%d,"connect_time":%s}'
    write("dash.json", '{"client":[%s,%s]}\n{"client":[]}\n{"other":1}\n' % (
        client % ("a", 1, 0.5), client % ("b", 2, 1.5)))
    write("raw.json", '{"client":{"myname":"c","connect_time":2.5},"server":{"timestamp":3}}\n')
    write("flat.json", client % ("d", 4, 3.5) + "\n")
    assert rows(read_mlab_ip(spark, str(tmp_path))) == [
        (1, "a", 0.5), (2, "b", 1.5), (3, "c", 2.5), (4, "d", 3.5)]
    counts = count_mlab_clients(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[1]: r.records for r in counts.collect()}
    assert got == {"dash.json": 2, "raw.json": 1, "flat.json": 1}


def test_synthetic(spark):
    df = read_synthetic(spark, devices=3, points=400, sensors=2, null_ratio=0.25)
    by_device = df.groupBy("deviceId").agg(
        F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b"))
    assert rows(by_device) == [(f"root.device_{i}", 400, 0, 399) for i in range(3)]
    share = df.agg(F.avg(F.col("sensor_1").isNull().cast("int"))).first()[0]
    assert 0.15 < share < 0.35
    assert df.where("sensor_0 < 0 or sensor_0 >= 1").count() == 0
    assert rows(df) == rows(read_synthetic(spark, 3, 400, 2, 0.25))
    assert dict(df.dtypes)["sensor_1"] == "double"
    wide = generate_wide(spark, 1, 1000)
    assert len(wide.columns) == 1002 and wide.count() == 1


def test_list_files(spark, write, tmp_path):
    for name in ("b/2.csv", "a/1.csv", "c/3.txt"):
        write(name, "x")
    got = [f.rsplit("/", 2)[1:] for f in list_files(spark, str(tmp_path))]
    assert got == [["a", "1.csv"], ["b", "2.csv"], ["c", "3.txt"]]
    assert [f[-5:] for f in list_files(spark, str(tmp_path), 1, 1)] == ["2.csv"]
    assert len(list_files(spark, str(tmp_path), suffix=".csv")) == 2


def test_large_lookups_are_not_broadcast(spark, write, tmp_path, small_blocks, monkeypatch):
    for i in range(20):
        write(f"f{i}.csv", f"Time,root.d{i}.s{i % 3},root.d{i}.t\n" + "".join(
            f"{t},{t + i},x{t}\n" for t in range(30)))
    small = read_csv_series(spark, str(tmp_path))
    numbered = number_lines(read_lines(spark, str(tmp_path)))
    want, want_numbers = rows(small), rows(numbered)
    monkeypatch.setattr("sparkseries.storage.BROADCAST_MAX_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(read_csv_series(spark, str(tmp_path))) == want
        assert rows(number_lines(read_lines(spark, str(tmp_path)))) == want_numbers
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(want) == 600 and len(want_numbers) == 620


def test_line_numbers_survive_another_split_size(spark, tmp_path):
    from sparkseries.sources import number_lines, read_lines

    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000")
        numbered = number_lines(read_lines(spark, str(tmp_path)))
        spark.conf.set(key, "7777")
        got = {r.line_no: r.value for r in numbered.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: f"line {i}" for i in range(1, 5001)}


def test_device_folders_keep_their_names(spark, tmp_path):
    from sparkseries.sinks import write_table
    from sparkseries.sources import scan_orc, scan_parquet

    df = spark.createDataFrame([(1, "007", 1.0), (2, "010", 2.0)], "time long, deviceId string, v double")
    for kind, scan in (("parquet", scan_parquet), ("orc", scan_orc)):
        path = str(tmp_path / kind)
        write_table(df, path, kind, "device")
        got = sorted((r.time, r.deviceId) for r in scan(spark, path, ["v"]).collect())
        assert got == [(1, "007"), (2, "010")]


def test_series_named_like_key_columns_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,time,deviceId,time_\n1,10,x,20\n")
    table = read_csv_series(spark, str(tmp_path), CsvSeries(normalize=False))
    row = table.first().asDict()
    assert row == {"time": 1, "deviceId": "a", "time__": 10, "deviceId_": "x", "time_": 20}
