import pytest
from pyspark.sql import functions as F

from sparkseries.operators import downsample
from sparkseries.streaming import downsample_stream, ingest_stream, progress_report, read_stream

SCHEMA = "time long, deviceId string, value double"


def points(spark, times):
    return spark.createDataFrame([(t, "d", float(t)) for t in times], SCHEMA)


def test_ingest_once_per_record(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    points(spark, range(0, 100)).repartition(4).write.parquet(source)
    stream = read_stream(spark, source, points(spark, []).schema, files_per_batch=1)
    query = ingest_stream(stream, target, checkpoint=state)
    query.awaitTermination()
    assert spark.read.parquet(target).count() == 100
    report = progress_report(query)
    assert len(report) >= 4 and sum(r["records"] for r in report) == 100
    # A second run with the same state takes only what is new.
    points(spark, range(100, 130)).write.mode("append").parquet(source)
    ingest_stream(stream, target, checkpoint=state).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == 130 and got.select("time").distinct().count() == 130


def test_text_stream_with_parsing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 0.5\n2 1.5\n")
    lines = read_stream(spark, str(tmp_path / "in"), file_format="text")

    def parse(df):
        items = F.split("value", " ")
        return df.select(
            items[0].cast("long").alias("time"), items[1].cast("double").alias("value"))

    ingest_stream(lines, str(tmp_path / "out"), "orc", transform=parse).awaitTermination()
    assert spark.read.orc(str(tmp_path / "out")).count() == 2


def _run(spark, tmp_path, name, batches, delay):
    source, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
    schema = points(spark, []).schema
    state = str(tmp_path / f"{name}-state")
    for times in batches:
        points(spark, times).coalesce(1).write.mode("append").parquet(source)
        counted = downsample_stream(
            read_stream(spark, source, schema), "value", "10 seconds", delay)
        ingest_stream(counted, out, checkpoint=state, chunked=False).awaitTermination()
    return sorted((r.bucket, r.points) for r in spark.read.parquet(out).collect())


def test_stream_equals_batch(spark, tmp_path):
    times = [t * 700 for t in range(200)]
    closing = [10_000_000]
    got = _run(spark, tmp_path, "s", [times, closing], "5 seconds")
    batch = downsample(points(spark, times), "value", 0, 200_000, 10_000, tag=None)
    assert got == sorted((r.bucket, r.points) for r in batch.collect())


def test_late_rows(spark, tmp_path):
    """Rows behind the watermark are dropped, rows within the delay are counted."""
    batches = [[1_000, 60_000], [2_000, 61_000], [200_000]]
    strict = _run(spark, tmp_path, "strict", batches, "1 second")
    assert (0, 1) in strict
    patient = _run(spark, tmp_path, "patient", batches, "90 seconds")
    assert (0, 2) in patient
    assert (60_000, 2) in strict and (60_000, 2) in patient


def test_later_files_reach_the_table(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    values = spark.range(120).selectExpr("id as time", "'d' as deviceId", "double(id) as value")
    values.where("time < 3").coalesce(1).write.parquet(source)
    rows = read_stream(spark, source, values.schema)
    ingest_stream(rows, target, chunked=False).awaitTermination()
    values.where("time >= 3").repartitionByRange(117, "time").write.mode("append").parquet(source)
    rows = read_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    query = ingest_stream(rows, target, chunked=False)
    query.awaitTermination()
    assert spark.read.parquet(target).count() == 120
    assert sum(r["records"] for r in progress_report(query)) == 117
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest_stream(rows, target, checkpoint=str(tmp_path / "new"), chunked=False)
