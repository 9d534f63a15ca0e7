"""Loads, clustered files, counts by chunk, parts that join without a shuffle, windows kept up."""

import random
import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from sparkseries.operators import age_windows, count_age_windows, moving_mean, update_age_windows
from sparkseries.sinks import (
    count_loads,
    ledger,
    load_table,
    loaded_rows,
    read_joined_parts,
    scan_loads,
    write_joined_parts,
)

SCHEMA = "time long, deviceId string, value double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points():
    draw = random.Random(7)
    rows = [(draw.randrange(0, 5000), f"d{draw.randrange(12)}", draw.choice([None, 1.0])) for _ in range(900)]
    rows += [(draw.randrange(0, 5000), "hot", 2.0) for _ in range(500)]
    return rows + [(None, "d1", 1.0), (77, None, 1.0), (77, None, None), (1000, "hot", 1.0)] + [(999, "d2", 1.0)] * 30


@pytest.fixture(scope="module")
def stored(spark, points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("a b") / "table")
    for i in range(2):
        rows = spark.createDataFrame(points[i::2], SCHEMA).repartition(3)
        assert load_table(rows, path, f"l{i}", rows_per_file=50, chunk=1000)
        assert not load_table(rows, path, f"l{i}", rows_per_file=50, chunk=1000)
    return path


def test_loads_hold_once(spark, points, stored):
    got = loaded_rows(spark, stored)
    assert Counter((r.time, r.deviceId, r.value) for r in got.collect()) == Counter(points)
    assert sorted((r.load, r.rows) for r in ledger(spark, stored).collect()) == [
        ("l0", len(points[0::2])), ("l1", len(points[1::2]))]


def test_ranges_follow_the_work_and_files_their_rows(spark, tmp_path, monkeypatch):
    """Rows sampled on the driver grow with the ranges, so these do not follow the number of files."""
    rows = spark.createDataFrame([(t, f"d{t % 3}", 1.0) for t in range(600)], SCHEMA)
    ranges, deal = [], type(rows).repartitionByRange

    def counted(self, number, *columns):
        ranges.append(number)
        return deal(self, number, *columns)

    monkeypatch.setattr(type(rows), "repartitionByRange", counted)
    path = str(tmp_path / "t")
    load_table(rows, path, "one", rows_per_file=5, chunk=1000)
    assert ranges == [1]
    files = spark.read.parquet(f"{path}/files").orderBy("first_tag", "first_time").collect()
    assert len(files) == 120 and {f.rows for f in files} == {5}
    assert all((a.last_tag, a.last_time) < (b.first_tag, b.first_time) for a, b in zip(files, files[1:]))
    monkeypatch.setattr("sparkseries.sinks.loads.TASK_ROWS", 100)
    load_table(rows, path, "two", rows_per_file=5, chunk=1000)
    assert ranges == [1, 6] and loaded_rows(spark, path).count() == 1200


def test_a_load_that_failed_is_not_read_and_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    load_table(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), path, "one")
    bad = spark.createDataFrame([(2, "a", 1.0), (3, "a", 1.0)], SCHEMA)
    with pytest.raises(Exception, match="no_such"):
        load_table(bad, path, "two", fields=["no_such"])
    assert [r.time for r in loaded_rows(spark, path).collect()] == [1]
    assert load_table(bad, path, "two")
    assert sorted(r.time for r in loaded_rows(spark, path).collect()) == [1, 2, 3]
    assert load_table(spark.createDataFrame([(9, "z", 1.0)], SCHEMA), path, "three", "overwrite")
    assert [r.time for r in loaded_rows(spark, path).collect()] == [9]
    assert load_table(bad.limit(0), path, "none") and loaded_rows(spark, path).count() == 1
    with pytest.raises(ValueError, match="load names"):
        load_table(bad, path, "a/b")


def test_a_device_opens_few_files(spark, points, stored):
    """Files opened follow the rows of the device, not the size of the table."""
    everything = len(loaded_rows(spark, stored).inputFiles())
    for device in ["d3", "hot", "absent", None]:
        for start, end in [(None, None), (1000, 1999), (1500, 1600)]:
            found = scan_loads(spark, stored, ["value"], device, start, end)
            want = [
                r for r in points if (device is None or r[1] == device)
                and (start is None or (r[0] is not None and start <= r[0] <= end))
            ]
            assert Counter((r.time, r.deviceId, r.value) for r in found.collect()) == Counter(want)
            if device is not None:
                chunks = (6 if start is None else 1) * 2
                assert len(found.inputFiles()) <= min(2 * chunks + len(want) / 25, everything)
                assert device == "hot" or len(found.inputFiles()) < everything / 2


def test_counts_of_random_ranges(spark, points, stored):
    draw = random.Random(3)
    for _ in range(12):
        devices = sorted(draw.choice([None, "d1", "d10", "d5", "hot", "i"]) or "" for _ in range(2))
        first, last = (d or None for d in devices)
        times = sorted(draw.choice([0, 999, 1000, 1999, 2000, 2500, 3999, 4000, 5000]) for _ in range(2))
        start, end = (t if draw.random() < 0.8 else None for t in times)
        want = Counter(
            d for t, d, v in points
            if (first is None or (d is not None and d >= first)) and (last is None or (d is not None and d <= last))
            and (start is None or (t is not None and t >= start)) and (end is None or (t is not None and t <= end))
            and v is not None
        )
        got = count_loads(spark, stored, "value", first, last, start, end)
        assert got.first().points == sum(want.values()), (first, last, start, end)
        each = count_loads(spark, stored, "value", first, last, start, end, by_device=True)
        assert Counter({r.deviceId: r.points for r in each.collect()}) == want


def test_counts_read_the_edges_only(spark, stored):
    plan = plan_of(count_loads(spark, stored, "value", "d1", "d5", 500, 3200))
    assert re.search(r"PartitionFilters: \[[^\]]*time_chunk#\S+ IN \(0,3000\)", plan), plan
    whole = plan_of(count_loads(spark, stored, "value", "d1", "d5", 1000, 2999))
    assert "/rows" not in whole and "/counts" in whole


def test_parts_join_without_a_shuffle(spark, tmp_path):
    rows = [(None, "a", 1, 2.0, "x", None, True), (None, "a", 1, 2.0, "x", None, True), (5, None, 2, None, "y", "q", False)]
    rows += [(i % 4, "b", i, i / 2, str(i), None, None) for i in range(200)]
    df = spark.createDataFrame(rows, "time long, deviceId string, a int, b double, c string, `d e` string, f boolean")
    names = write_joined_parts(df, str(tmp_path / "p"), max_fields=2, buckets=4)
    assert names == ["part_1", "part_2", "part_3"]
    back = read_joined_parts(spark, str(tmp_path / "p"))
    assert back.columns == df.columns
    assert Counter(map(tuple, back.collect())) == Counter(rows)
    plan = plan_of(read_joined_parts(spark, str(tmp_path / "p")))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    few = read_joined_parts(spark, str(tmp_path / "p"), ["f", "a"])
    plan = plan_of(few)
    assert few.columns == ["time", "deviceId", "f", "a"] and plan.count("SortMergeJoin") == 1
    assert Counter(map(tuple, few.collect())) == Counter((r[0], r[1], r[6], r[2]) for r in rows)
    with pytest.raises(ValueError, match="repeats"):
        write_joined_parts(df, str(tmp_path / "u"), unique=True)
    with pytest.raises(ValueError, match="no part holds"):
        read_joined_parts(spark, str(tmp_path / "p"), ["zz"])


def plain_level(start, now):
    level = 0
    for k in range(1, 41):
        if now + 1 - ((start >> k) + 1) * (1 << k) >= 1 << k:
            level = k
    return level


def test_age_windows_of_loads(spark, tmp_path):
    draw, path = random.Random(5), str(tmp_path / "w")
    times = []
    for load in range(4):
        new = [draw.randrange(-300, 400 * (load + 1)) for _ in range(150)] + [None]
        times += [t for t in new if t is not None]
        rows = spark.createDataFrame([(t, "d", 1.0) for t in new], SCHEMA)
        assert update_age_windows(rows, path, f"l{load}", 10, "time")
        assert not update_age_windows(rows, path, f"l{load}", 10, "time")
    now = max(t // 10 for t in times)
    want = Counter()
    for t in times:
        level = plain_level(t // 10, now)
        want[((t // 10 >> level << level) * 10, level)] += 1
    got = {(r.start, r.level): (r.until, r.points) for r in age_windows(spark, path).collect()}
    assert {k: n for k, (_, n) in got.items()} == want
    assert all(until == start + (10 << level) for (start, level), (until, _) in got.items())
    assert len(got) <= 4 * (max(level for _, level in got) + 2)
    largest = max(n for _, n in got.values())
    for _ in range(25):
        start, end = sorted(draw.randrange(-400, 1800) for _ in range(2))
        exact = sum(start <= t < end for t in times)
        r = count_age_windows(spark, path, start, end).first()
        assert r.least <= exact <= r.most and r.least <= r.estimate <= r.most
        assert r.most - r.least <= 2 * largest


def test_a_failed_update_is_done_again(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.createDataFrame([(1, "d", 1.0)], SCHEMA)
    update_age_windows(rows, path, "a", 10, "time")
    with pytest.raises(Exception):
        update_age_windows(rows.withColumn("time", F.raise_error(F.lit("lost")).cast("long")), path, "b", 10, "time")
    update_age_windows(rows, path, "b", 10, "time")
    assert [r.points for r in age_windows(spark, path).collect()] == [2]
    update_age_windows(rows.limit(0), str(tmp_path / "e"), "a", 10, "time")
    assert age_windows(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("last", [1, 3, 50, 10_000])
def test_moving_mean(spark, last):
    draw = random.Random(last)
    rows = [(i, draw.choice(["a", "b", None]), draw.choice([None, *range(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, v long").repartition(5)
    got = {r.i: (r.mean, r.n) for r in moving_mean(df, "v", ["i"], last).collect()}
    each = {r.i: (r.mean, r.n) for r in moving_mean(df, "v", ["i"], last, ["k"]).collect()}
    for found, key in ((got, lambda r: 0), (each, lambda r: r[1])):
        held = {}
        for r in rows:
            recent = held.setdefault(key(r), deque(maxlen=last))
            recent.append(r[2])
            values = [v for v in recent if v is not None]
            mean, n = found[r[0]]
            assert n == len(values) and (mean == pytest.approx(sum(values) / n) if n else mean is None)


def test_moving_mean_needs_no_single_partition(spark):
    df = spark.range(1000).selectExpr("id as i", "id as v")
    plan = plan_of(moving_mean(df, "v", ["i"], 100))
    window = plan[plan.index("Window [avg"):]
    assert "hashpartitioning(__run" in window[:2500] and "SinglePartition" not in window[:2500]
