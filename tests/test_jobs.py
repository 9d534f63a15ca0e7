import json

import pytest
from pyspark.sql import functions as F

from sparkseries import TAG, TIME, jobs
from sparkseries.operators import latency_report
from sparkseries.sources import read_synthetic


@pytest.fixture(scope="module")
def series(spark):
    return read_synthetic(spark, devices=3, points=50, sensors=2, null_ratio=0.2).toDF(
        TIME, TAG, "sensor1", "sensor2")


def test_load_and_query_from_the_command_line(spark, write, tmp_path, capsys):
    write("in/a.csv", "Time,root.d.sensor1,root.d.sensor2\n1,2,x\n5,,y\n9,4,\n")
    write("in/b.csv", "Time,root.e.sensor1\n1,7\n")
    out = str(tmp_path / "out")
    load = ["load", "--source", "csv", "--path", str(tmp_path / "in"), "--out", out]
    jobs.main(load, spark)
    report = json.loads(capsys.readouterr().out)
    assert (report["records"], report["points"], report["present_points"]) == (4, 8, 5)
    ask = ["query", "--table", out, "--field", "asensor1", "--device", "root.ad"]
    lines = []
    for kind, param, more in [
        ("raw", 1, []), ("count", 7, ["--until", "9"]),
        ("downsample", 4, ["--start", "0", "--end", "10", "--fill"]),
    ]:
        jobs.main([*ask, "--kind", kind, "--param", str(param), *more], spark)
        lines += capsys.readouterr().out.splitlines()
    assert [json.loads(x)["lines"] for x in lines[::2]] == [1, 1, 3]
    log = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    report = latency_report(log, ["line_no"])
    assert sorted(r.query_parameter for r in report.collect()) == [1, 4, 7]
    jobs.main([*load, "--begin-file", "1", "--end-file", "1"], spark)
    assert json.loads(capsys.readouterr().out)["records"] == 1


@pytest.mark.parametrize("sink", ["parquet", "orc", "discard", *jobs.PAYLOADS])
def test_every_sink(spark, series, tmp_path, sink):
    out = str(tmp_path / "out")
    report = jobs.load(series, sink, out)
    present = series.agg(F.count("sensor1") + F.count("sensor2")).first()[0]
    assert report["records"] == 150 and report["points"] == 300
    assert report["present_points"] == present
    if sink in ("parquet", "orc"):
        assert spark.read.format(sink).load(out).count() == 150
    if sink in ("json_single", "metric"):
        assert spark.read.text(out).count() == present


def test_query_shapes(series):
    device = "root.device_1"
    assert jobs.timed_query(jobs.query(series, "raw", 5, device, "sensor1"))["lines"] == 5
    aligned = jobs.timed_query(jobs.query(series, "align", 2, device))
    assert 40 < aligned["lines"] <= 50 and aligned["points"] == 2 * aligned["lines"]
    counted = jobs.query(series, "count", 100, device, "sensor1").first().points
    assert counted == series.where(f"{TAG} = '{device}'").agg(F.count("sensor1")).first()[0]
    buckets = jobs.query(series, "downsample", 10, device, "sensor1", start=0, end=50)
    assert buckets.count() == 5
    with pytest.raises(ValueError):
        jobs.query(series, "other", 1)


@pytest.mark.parametrize("source, name, text, records", [
    ("geolife", "000/Trajectory/a.plt", "h\n1,2,0,3,4,2008-10-23,02:53:04\n", 1),
    ("redd", "house_1/channel_1.dat", "1 2.5\n2 3.5\n", 2),
    ("tdrive", "1.txt", "1,2008-02-02 15:36:08,116.5,39.9\n", 1),
    ("mlab_ip", "x.json", '{"real_address":"a","timestamp":1,"connect_time":2}\n', 1),
])
def test_sources_by_kind(spark, write, tmp_path, source, name, text, records):
    write(f"in/{name}", text)
    write(f"in/zzz/{name}", text)
    df = jobs.read(spark, source, str(tmp_path / "in"))
    assert jobs.load(df, "discard")["records"] == 2 * records
    first = jobs.read(spark, source, str(tmp_path / "in"), end=0)
    assert jobs.load(first, "discard")["records"] == records


def test_wide_scan(spark, tmp_path):
    report = jobs.wide_scan(spark, str(tmp_path), 1000)
    assert report["parquet"]["lines"] == report["orc"]["lines"] == 1


def test_a_device_of_digits_is_not_its_padded_form(spark, tmp_path, capsys):
    out = str(tmp_path / "padded")
    rows = [(1, "010", 1.0), (2, "010", 2.0), (1, "10", 3.0)]
    jobs.load(spark.createDataFrame(rows, "time long, deviceId string, v double"), "parquet", out, "device")
    for device, lines in (("10", 1), ("010", 2)):
        jobs.main(["query", "--table", out, "--kind", "raw", "--param", "9", "--device", device, "--field", "v"], spark)
        assert json.loads(capsys.readouterr().out.splitlines()[0])["lines"] == lines
