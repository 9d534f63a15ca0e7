"""Numbering in slices gives the numbers of an ordinary window."""

import random

import pytest
from pyspark.sql import functions as F

from sparkseries.operators import first_rows, first_rows_per_group, number_rows, ranking
from sparkseries.operators import extend_series, group_points


def brute(rows, key, order):
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    return sorted(
        ((i, *r) for group in groups.values() for i, r in enumerate(sorted(group, key=order), 1)),
        key=repr,
    )


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows are copies of one row, half of the others share a key."""
    rng = random.Random(1)
    rows = [("hot", 5, 1.5)] * 400
    rows += [("hot", rng.randrange(1000), rng.random()) for _ in range(400)]
    rows += [(rng.choice("abcde"), rng.randrange(50), rng.random()) for _ in range(300)]
    rows += [(None, rng.randrange(50), rng.random()) for _ in range(100)]
    rows += [("zero", 1, -0.0), ("zero", 2, 0.0), ("zero", 3, -0.0), ("zero", 4, float("nan"))]
    rng.shuffle(rows)
    return rows


SCHEMA = "k string, t long, v double"


@pytest.mark.parametrize("run", [30, 100_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_number_rows(spark, skewed, run, keys, monkeypatch):
    monkeypatch.setattr(ranking, "COPIES_PER_RUN", run)
    df = spark.createDataFrame(skewed, SCHEMA).repartition(5)
    got = number_rows(df, keys, ["t"], name="n")
    rows = sorted((tuple([r.n, r.k, r.t, r.v]) for r in got.collect()), key=repr)
    key = (lambda r: r[0]) if keys else (lambda r: 0)
    ordered = lambda r: (r[1], r[0] is not None, r[0] or "", r[2])
    assert repr(rows) == repr(brute(skewed, key, ordered))


def test_number_rows_descending(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA)
    got = number_rows(df, ["k"], [F.col("t").desc(), F.col("v").desc()])
    for _, rows in _by(got.collect(), "k").items():
        rows.sort(key=lambda r: r.row_no)
        assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
        assert [(r.t, r.v) for r in rows] == sorted(((r.t, r.v) for r in rows), reverse=True)


def _by(rows, key):
    groups = {}
    for r in rows:
        groups.setdefault(r[key], []).append(r)
    return groups


def test_large_limits_take_the_split_route(spark, skewed, monkeypatch):
    df = spark.createDataFrame(skewed, SCHEMA)
    small = first_rows(df, ["t"], 700).collect()
    monkeypatch.setattr(ranking, "TOP_N_ONE_TASK", 10)
    large = first_rows(df, ["t"], 700)
    assert list(map(repr, large.collect())) == list(map(repr, small))
    assert "SinglePartition" not in large._jdf.queryExecution().toString().replace("TakeOrdered", "")
    for n in (90, 101, 500, 5000):
        want = df.orderBy(*ranking.total_order(df, [], ["t"])).limit(n).collect()
        assert list(map(repr, first_rows(df, ["t"], n).collect())) == list(map(repr, want))


def test_large_limits_with_nulls_and_wide_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_N_ONE_TASK", 10)
    monkeypatch.setattr(ranking, "BOUND_BUCKETS", 4)
    rows = [(None, i) for i in range(30)] + [(i * 10**15 - 10**17, i) for i in range(200)]
    for extreme in ([], [(-(2**63), 1), (2**63 - 1, 2)]):
        df = spark.createDataFrame(rows + extreme, "t long, v long")
        for n in (20, 30, 45, 150):
            want = df.orderBy("t", "v").limit(n).collect()
            assert first_rows(df, ["t"], n).collect() == want
    assert first_rows(df.limit(0), ["t"], 50).collect() == []


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "bigint"])
def test_large_limits_reduce_the_rows_first(spark, monkeypatch, kind):
    monkeypatch.setattr(ranking, "TOP_N_ONE_TASK", 10)
    moment = F.timestamp_seconds(F.col("id") * 7 % 5003 * 1000).cast(kind)
    df = spark.range(5003).select(moment.alias("t"), "id")
    got = {r.id for r in first_rows(df, ["t"], 300).collect()}
    assert got == {i for i in range(5003) if i * 7 % 5003 < 300}


def test_first_rows_per_group(spark, skewed):
    df = spark.createDataFrame(skewed, SCHEMA)
    few = first_rows_per_group(df, ["k"], ["t"], 7).collect()
    many = first_rows_per_group(df, ["k"], ["t"], 5000).collect()
    assert len(many) == len(skewed)
    assert {k: len(g) for k, g in _by(few, "k").items()} == {
        k: min(7, len(g)) for k, g in _by(many, "k").items()}


def test_number_rows_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], SCHEMA), ["k"], ["t"]).count() == 0


def test_grouping_and_extension(spark, skewed):
    df = spark.createDataFrame(skewed, "deviceId string, time long, value double")
    batches = group_points(df.withColumn("field", F.lit("f")), 50).collect()
    extended = _by(extend_series(df, 3).collect(), "deviceId")
    for device, rows in _by(df.collect(), "deviceId").items():
        own = sorted((r for r in batches if r.deviceId == device), key=lambda r: r.batch)
        assert [len(r.datapoints) for r in own] == [
            min(50, len(rows) - at) for at in range(0, len(rows), 50)]
        points = [tuple(p) for r in own for p in r.datapoints]
        assert [t for t, _ in points] == sorted(r.time for r in rows)
        assert sorted(map(repr, points)) == sorted(repr((r.time, r.value)) for r in rows)
        last = max(r.time for r in rows)
        times = sorted(r.time for r in extended[device])
        assert times == sorted(r.time for r in rows) + list(range(last, last + 3 * len(rows)))
