"""Streams by batch: late rows, messages and progress, with batches that fail and come again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkseries.sinks import line_protocol
from sparkseries.streaming import (
    batch_progress,
    ingest_batches,
    late_stream,
    payload_stream,
    read_messages,
    read_stream,
    run_batches,
    stored_rows,
    window_totals,
)
from sparkseries.streaming.batches import Part

SCHEMA = "time long, deviceId string, value double"


def add(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)


def test_late_rows_correct_closed_windows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [
        [(1, "a", 1.0), (11, "a", 1.0), (11, None, 1.0), (None, "a", 1.0)],
        [(2, "a", 1.0), (29, "a", 1.0), (3, "b", None)],  # window 0 is not closed: newest 11, delay 5
        [(4, "a", 1.0), (18, "a", 1.0), (21, "a", 1.0), (5, "c", 1.0), (5, None, 1.0)],  # closed: up to 24
        [(4, "a", 1.0), (100, "a", 1.0)],
    ]
    for rows in parts:
        late_stream(add(spark, source, rows), path, "value", 10, 5).awaitTermination()
    everything = [r for part in parts for r in part]
    got = stored_rows(spark, path).collect()
    assert Counter((r.time, r.deviceId, r.value) for r in got) == Counter(everything)
    late = sorted((r.batch, r.time, r.deviceId) for r in stored_rows(spark, path, late=True).collect() if r.deviceId)
    assert late == [(2, 4, "a"), (2, 5, "c"), (2, 18, "a"), (3, 4, "a")]
    totals = {(r.deviceId, r.bucket): tuple(r)[2:] for r in window_totals(spark, path).collect()}
    assert totals[("a", 0)] == (4, 2, 2, True)
    assert totals[("a", 10)] == (2, 1, 1, True)
    assert totals[("a", 20)] == (2, 0, 0, True)
    assert totals[("b", 0)] == (0, 0, 0, True)
    assert totals[("c", 0)] == (1, 1, 1, True)
    assert totals[(None, 0)] == (1, 1, 1, True) and totals[(None, 10)] == (1, 0, 0, True)
    assert totals[("a", 100)] == (1, 0, 0, False)
    on_time = {(r.deviceId, r.bucket): r.points for r in window_totals(spark, path, corrected=False).collect()}
    assert on_time[("a", 0)] == 2


def test_late_stream_names_its_columns(spark, tmp_path):
    rows = spark.readStream.format("rate").load().selectExpr("value as time", "'d' as deviceId", "1 as Late")
    with pytest.raises(ValueError, match="late"):
        late_stream(rows, str(tmp_path / "x"), "Late", 10, 5)


@pytest.mark.parametrize("fails_after", ["rows", "windows", "marks"])
def test_a_batch_that_failed_is_done_again(spark, tmp_path, monkeypatch, fails_after):
    """Whatever had been written when the batch ended, the rows and windows hold once."""
    from sparkseries.streaming import late

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    late_stream(add(spark, source, [(1, "a", 1.0), (50, "a", 1.0)]), path, "value", 10, 5).awaitTermination()
    real = run_batches

    def failing(stream, path, parts, *rest):
        def some(batch, number):
            for part in parts(batch, number):
                yield part
                if part.name == fails_after:
                    raise RuntimeError("killed")

        return real(stream, path, some, *rest)

    stream = add(spark, source, [(2, "a", 1.0), (60, "a", 1.0)])
    monkeypatch.setattr(late, "run_batches", failing)
    with pytest.raises(Exception, match="killed"):
        late_stream(stream, path, "value", 10, 5).awaitTermination()
    monkeypatch.setattr(late, "run_batches", real)
    late_stream(stream, path, "value", 10, 5).awaitTermination()
    assert sorted((r.time, r.late) for r in stored_rows(spark, path).collect()) == [
        (1, False), (2, True), (50, False), (60, False)]
    assert {(r.bucket, r.points, r.late_points) for r in window_totals(spark, path).collect()} == {
        (0, 2, 1), (50, 1, 0), (60, 1, 0)}


def test_messages_once_after_a_killed_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    killed = []

    def lines(batch):
        return line_protocol(batch)

    def parts(batch, number):
        yield Part("messages", lines(batch).toDF("value"), "text")
        if number == 1 and not killed:
            killed.append(number)
            raise RuntimeError("killed")

    payload_stream(add(spark, source, [(1, "a", 1.5)]), path, lines).awaitTermination()
    stream = add(spark, source, [(2, "a", 2.5), (2, "a", 2.5)])
    with pytest.raises(Exception, match="killed"):
        run_batches(stream, path, parts).awaitTermination()
    payload_stream(stream, path, lines).awaitTermination()
    got = sorted((r.batch, r.value) for r in read_messages(spark, path).collect())
    want = "tb1,deviceId=a value={} {}"
    assert got == [(0, want.format(1.5, 1_000_000)), *[(1, want.format(2.5, 2_000_000))] * 2]


def test_progress_lasts_over_runs(spark, tmp_path):
    """More batches than a query remembers, over two runs, and no setting of the session changed."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, 3)
    before = dict(spark.conf.getAll)
    rows = spark.range(24).selectExpr("id as time", "'d' as deviceId", "double(id) as value")
    rows.repartitionByRange(8, "time").write.parquet(source)
    for _ in range(2):
        stream = read_stream(spark, source, rows.schema, files_per_batch=1)
        query = ingest_batches(stream, path, chunked=False)
        query.awaitTermination()
        assert len(query.recentProgress) <= 4
        rows.withColumn("time", F.col("time") + 1000).repartitionByRange(6, "time").write.mode("append").parquet(source)
    assert dict(spark.conf.getAll) == before
    spark.conf.unset(kept)
    done = batch_progress(spark, path).collect()
    assert sorted(r.batch for r in done) == list(range(14))
    assert sum(r.records for r in done) == 48 == spark.read.parquet(f"{path}/rows").count()
