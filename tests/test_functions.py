import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseries import types as S
from sparkseries.functions import (
    bucket_start,
    cut_position,
    device_part,
    epoch_ms,
    field_part,
    file_stem,
    infer_type_rank,
    normalize_name,
    pad_row,
    parse_time,
    relative_path,
    safe_parse,
    sql_escape_text,
    sql_identifier,
    strip_outer_quotes,
    time_bound,
)


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_normalize_name(spark):
    names = {
        "root.T0001.90401.struct@waste%105006": "root.aT0001.a90401.astructawastea105006",
        "root.host_9.writes(INT64)": "root.ahost_9.awritesaINT64a",
        "TotalWastePct-123": "aTotalWastePcta123",
        "root": "root",
        "a.root.b": "aa.root.ab",
        "a.b.": "aa.ab",
        ".x": "a.ax",
        "": "a",
        "..": "",
    }
    assert apply(spark, normalize_name, list(names)) == list(names.values())


def test_device_and_field(spark):
    names = ["root.d1.s1", "s1", "a.b.c.d"]
    cut = [7 + 1, 0, 6]
    assert apply(spark, cut_position, names) == cut
    assert apply(spark, lambda c: device_part(c, cut_position(c)), names) == [
        "root.d1", None, "a.b.c"]
    assert apply(spark, lambda c: field_part(c, cut_position(c)), names) == ["s1", "s1", "d"]


def test_paths(spark):
    paths = ["file:///data/x/000/Trajectory/1.plt", "/data/x/a.b.csv", "/data/x/plain"]
    assert apply(spark, file_stem, paths) == ["1", "a.b", "plain"]
    assert apply(spark, lambda c: relative_path(c, "/data/x"), paths) == [
        "000/Trajectory/1.plt", "a.b.csv", "plain"]


RANKS = {
    "12": 1, "-7": 1, "+3": 1, "9223372036854775807": 1,
    "9223372036854775808": 2, "1.5": 2, "1e5": 2, ".5": 2, " 12": 2, "NaN": 2, "-Infinity": 2,
    "nan": 3, "inf": 3, "infinity": 3, '"12"': 3, "x": 3, "1,5": 3,
    "": None, "null": None, "NULL": None,
}


def test_infer_type_rank(spark):
    assert apply(spark, infer_type_rank, list(RANKS)) == list(RANKS.values())


def test_safe_parse(spark):
    cells = ["12", "1.5", "x", "", "NULL", "9223372036854775808", "1e999", "inf"]
    assert apply(spark, lambda c: safe_parse(c, "bigint"), cells) == [
        12, None, None, None, None, None, None, None]
    assert apply(spark, lambda c: safe_parse(c, "double"), cells) == [
        12.0, 1.5, None, None, None, 9223372036854775808.0, float("inf"), None]
    assert apply(spark, lambda c: safe_parse(c, "string"), cells) == [
        "12", "1.5", "x", None, None, "9223372036854775808", "1e999", "inf"]


def test_quotes(spark):
    cells = ["'a'", '"a"', "'a\"", "a", '"', "''", "'null'", '""a""', "'a\nb'"]
    assert apply(spark, strip_outer_quotes, cells) == [
        "a", "a", "'a\"", "a", '"', "", "null", '"a"', "a\nb"]
    assert apply(spark, sql_escape_text, ["it's"]) == ["'it\"s'"]
    assert sql_identifier("a.b-c") == '"a.b-c"'


def test_pad_row(spark):
    rows = [["a"], ["a", "b", "c"], []]
    got = apply(spark, lambda c: pad_row(c, 3), rows, "array<string>")
    assert got == [["a", None, None], ["a", "b", "c"], [None, None, None]]


def test_parse_time(spark):
    texts = [
        "2021-08-05T08:24:36.000+08:00", "2021-08-05T08:24:36.000Z", "2021-08-05T08:24:36.123",
        "1628123076000", "-5", "soon", "",
    ]
    assert apply(spark, parse_time, texts) == [
        1628123076000, 1628151876000, 1628151876123, 1628123076000, -5, None, None]
    shanghai = apply(spark, lambda c: parse_time(c, "Asia/Shanghai"), texts[2:3])
    assert shanghai == [1628123076123]
    cut = apply(spark, lambda c: parse_time(c, honour_offset=False), texts[:1])
    assert cut == [1628151876000]


def test_epoch_ms_ignores_the_session_zone(spark):
    # The second one does not exist as a local time in New York.
    texts = ["1969-12-31 23:59:59.9995", "2024-03-10 02:30:00.1239", "1970-01-01 00:00:00"]
    got = apply(spark, lambda c: epoch_ms(c.cast("timestamp_ntz")), texts)
    epoch = dt.datetime(1970, 1, 1)
    want = [(dt.datetime.fromisoformat(t) - epoch) // dt.timedelta(milliseconds=1) for t in texts]
    assert got == want


@pytest.mark.parametrize("origin", [0, 7])
def test_bucket_start(spark, origin):
    times = [-11, -10, -1, 0, 6, 7, 9, 10, 23]
    got = apply(spark, lambda c: bucket_start(c, 10, origin), times, "bigint")
    assert got == [(t - origin) // 10 * 10 + origin for t in times]


def test_bounds_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for value in (1704844800000, dt.datetime(2024, 1, 10), "2024-01-10T00:00:00"):
        plan = events.where(F.col("ts") <= time_bound(events, "ts", value))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(ts,2024-01-10T00:00)" in text


RANK = st.sampled_from([None, S.LONG, S.DOUBLE, S.TEXT])


@given(RANK, RANK, RANK)
def test_merge_type_laws(a, b, c):
    assert S.merge_type(a, b) == S.merge_type(b, a)
    assert S.merge_type(a, S.merge_type(b, c)) == S.merge_type(S.merge_type(a, b), c)
    assert S.merge_type(a, None) == a
    assert S.merge_type(a, a) == a


def test_schemas():
    schema = S.double_schema(S.NOAA_FIELDS)
    assert S.position_of(schema, "DEWP") == 3
    assert S.position_of(schema, "nothing") == -1
    assert S.same_schema(schema, S.double_schema(S.NOAA_FIELDS))
    assert not S.same_schema(schema, S.double_schema({**S.NOAA_FIELDS, "TEMP": 2}))
