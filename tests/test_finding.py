"""Files by number, devices by suffix and lines by the ids in them, on small tables."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseries.operators import lines_with_ids, transforms, write_split
from sparkseries.operators.grams import _marked, id_grams, marks
from sparkseries.operators.layout import spread
from sparkseries.sinks import write_table
from sparkseries.sources import (
    devices_ending,
    files_table,
    head_lines,
    number_lines,
    read_lines,
    scan_parquet,
    scan_suffix,
    update_device_names,
)
from sparkseries.sources.stored import open_table


def test_files_are_numbered_before_hidden_ones_go(spark, write, tmp_path):
    for name in ("b/2.csv", "a/1.csv", "a/deep/er/0.txt", "c d/.DS_Store", "c d/3.txt", "z+%/4.csv"):
        write(name, "x\ny\n")
    (tmp_path / "empty").mkdir()
    root = str(tmp_path)
    want = sorted(str(p) for p in tmp_path.rglob("*") if p.is_file())

    def found(*args):
        return {r.number: (r.file, r.bytes) for r in files_table(spark, *args).orderBy("number").collect()}

    assert found(root) == {i: (f, 4) for i, f in enumerate(want) if ".DS_Store" not in f}
    assert found("file://" + root, 1, 3) == {i: (want[i], 4) for i in (1, 2, 3) if ".DS_Store" not in want[i]}
    assert [f[0][-5:] for f in found(root, 0, None, ".csv").values()] == ["1.csv", "2.csv", "4.csv"]
    assert found(want[0]) == {0: (want[0], 4)}
    assert found(str(tmp_path / "empty")) == {}
    with pytest.raises(FileNotFoundError):
        files_table(spark, root + "/none")
    lines = read_lines(spark, root, files_table(spark, root, 3, 9))
    assert sorted(r.file[-5:] for r in lines.collect()) == ["3.txt"] * 2 + ["4.csv"] * 2


def test_first_and_chosen_lines(spark, tmp_path, small_blocks):
    for name, n in (("a", 1), ("b", 40), ("c", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    lines = read_lines(spark, str(tmp_path))
    got = sorted((r.value, r.line_no) for r in head_lines(lines, 12).collect())
    assert got == sorted((f"{a} line {i}", i) for a, n in (("a", 1), ("b", 12), ("c", 3)) for i in range(1, n + 1))
    chosen = number_lines(lines, F.col("value").endswith("7"))
    assert sorted((r.value, r.line_no) for r in chosen.collect()) == [(f"b line {i}", i) for i in (17, 27, 37, 7)]


LINES = [
    (1, "vm-0001,10,20", "x"), (2, "vm-00012", "x"), (None, "a vm-0001 and vm-0002", "x"), (None, "none", "y"),
    (3, None, "x"), (4, "", "x"), (5, "😀😀é", "x"), (5, "vm-0001", "y"), (5, "vm-0001", "y"), (6, "vm-00" * 5000, "z"),
    (7, "a.b[0]%_", "z"),
]
IDS = ["vm-0001", "vm-0002", "vm-0003", "vm-0001", None, "", "😀é", "1", "[0]%", "vm-00vm-00", "none", "vm-0001,10,20"]


@pytest.mark.parametrize("ids", [IDS, [i for i in IDS if i and len(i) >= 7], ["0"], ["abc", "zz"], [None, ""]])
@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_with_ids_match_a_plain_search(spark, ids, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr("sparkseries.storage.BROADCAST_MAX_ROWS", 0)
    lines = spark.createDataFrame(LINES, "key long, text string, __other string")
    listed = spark.createDataFrame([(i,) for i in ids], "id string")
    got = lines_with_ids(lines, listed, "text", "key", "id").collect()
    want = [(*row, i) for row in LINES for i in {x for x in ids if x} if row[1] and i in row[1]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert lines_with_ids(lines.limit(0), listed, "text", "key", "id").count() == 0
    assert lines_with_ids(lines, listed.limit(0), "text", "key", "id").count() == 0


def test_candidates_are_few_when_many_short_ids_are_listed(spark, monkeypatch):
    joined, join = [], transforms.join_measured

    def counted(*args, **more):
        joined.append(join(*args, **more))
        return joined[-1]

    monkeypatch.setattr(transforms, "join_measured", counted)
    texts = [f"no {i * 37 % 99991:05} of {i % 10}, 日本 {i}" for i in range(300)]
    lines = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    ids = ["7", "日", *(str(10_000 + 29 * i) for i in range(700)), "no 00037 of 1", "x" * 9]
    got = lines_with_ids(lines, spark.createDataFrame([(i,) for i in ids], "id string"), "text", "key", "id")
    want = sorted((k, i) for k, x in enumerate(texts) for i in ids if i in x)
    assert sorted((r.key, r.id) for r in got.collect()) == want
    assert max(df.count() for df in joined) <= len(want)


def test_grams_at_borders_of_pieces_and_texts(spark, monkeypatch):
    texts = ["", None, "ab" * 9 + "cdefghi", "\0\0a", "é", "abcdefgh", "h", "cdefghi" * 4]
    wanted = spark.createDataFrame([("bcdefgh",), ("cdefghi",), ("h",), ("\0a",), ("é",), ("bc",)], "id string")
    grams = wanted.select(F.explode(F.arrow_udf(id_grams, "array<bigint>")("id")).alias("gram"))
    found = marks(grams)
    sizes = [1, 2, 7]
    for piece in (1, 3, 1 << 16):
        monkeypatch.setattr("sparkseries.operators.grams.PIECE", piece)
        held = []
        for rows, codes in _marked(pa.array(["cut", *texts])[1:], sizes, found):
            held += zip(rows.tolist(), codes.tolist())
        ids = {int.from_bytes(r.id.encode(), "big") << 8 | len(r.id.encode()): r.id for r in wanted.collect()}
        got = sorted((row, ids[code]) for row, code in set(held) if code in ids)
        assert got == sorted((row, i) for row, x in enumerate(texts) for i in ids.values() if i in (x or ""))


def test_folders_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transforms, "TASK_FOLDERS", 4, raising=False)
    monkeypatch.setattr(transforms, "FILE_ROWS", 50, raising=False)
    rows = [(i % 40, "abc"[i % 3]) for i in range(400)] + [(7, "a")] * 400 + [(None, "a")] * 3
    readings = spark.createDataFrame(rows, "id long, v string")
    path = str(tmp_path / "out")
    write_split(readings, spark.createDataFrame([(i,) for i in range(40)], "id long"), "id", path, ["v"])
    files = list((tmp_path / "out").glob("id=*/part-*"))
    assert len({f.parent for f in files}) == 40
    # Many tasks write, and the id with most rows has files of several.
    assert len({f.name[:10] for f in files}) >= 6 and len([f for f in files if f.parent.name == "id=7"]) > 1
    got = open_table(spark, path, "parquet").groupBy("id", "v").count().collect()
    want = Counter((str(i), v) for i, v in rows if i is not None)
    assert {(r.id, r.v): r["count"] for r in got} == want


def test_a_folder_for_each_id_in_a_text(spark, tmp_path):
    lines = spark.createDataFrame(LINES, "key long, text string, other string")
    listed = spark.createDataFrame([("vm-0001",), ("a.b[0]%_",), ("nowhere",)], "id string")
    write_split(lines, listed, "id", str(tmp_path / "out"), ["key"], text="text", key="key")
    folders = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len(folders) == 2 and (tmp_path / "out" / "id=vm-0001").is_dir()
    kept = spark.read.parquet(str(tmp_path / "out" / "id=vm-0001"))
    assert sorted((r.key or 0) for r in kept.collect()) == [0, 1, 2, 5, 5]


def test_suffixes_reach_the_reader(spark, tmp_path, monkeypatch, capsys):
    names = [f"root.g{i % 7}.d{i:03}" for i in range(200)] + ["ü.😀", "x.😀", None]
    df = spark.createDataFrame([(t, n, float(t)) for t, n in enumerate(names)], "time long, deviceId string, v double")
    path, listed = str(tmp_path / "t"), str(tmp_path / "names")
    write_table(df, path, "parquet", "single")
    update_device_names(df.where("time < 100"), listed, "overwrite")
    for _ in range(2):
        update_device_names(df, listed)
    assert spark.read.parquet(listed).count() == 202

    def rows(frame):
        return sorted((r.time, r.deviceId, r.v) for r in frame.collect())

    for suffix in ("17", ".😀", "d005", "none", ""):
        want = rows(scan_parquet(spark, path, ["v"], suffix=suffix))
        for bound in (1000, 1):
            monkeypatch.setattr("sparkseries.sources.names.LISTED_DEVICES", bound)
            assert rows(scan_suffix(spark, path, listed, ["v"], suffix)) == want
    monkeypatch.undo()
    assert rows(scan_suffix(spark, path, listed, ["v"], "17", 100, 120)) == [(117, "root.g5.d117", 117.0)]
    scan_suffix(spark, path, listed, ["v"], "17").explain("formatted")
    assert "In(deviceId, [root.g" in capsys.readouterr().out
    devices_ending(spark, listed, "17").explain("formatted")
    assert "StringStartsWith(backward,71)" in capsys.readouterr().out


def test_spread_plans_agree(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 2.0), (1, "a", 3.0), (None, "b", None), (2, "c", 9.0), (None, "a", 4.0)],
        "k long, name string, v double")
    want = sorted(map(str, spread(df, ["k"], "name", ["b", "a", "x"], "v").collect()))
    assert spread(df, ["k"], "name", ["a"], "v")._jdf.queryExecution().toString().count("Exchange hash") >= 1
    monkeypatch.setattr("sparkseries.operators.layout.MAXIMA", 0)
    assert sorted(map(str, spread(df, ["k"], "name", ["b", "a", "x"], "v").collect())) == want
