"""Run the registered queries next to their SQL: ``python tests/check_oracles.py [sf] [names]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return ("n", repr(value + 0.0)) if value != int(value) else ("n", str(int(value)))
    if isinstance(value, int):
        return ("n", str(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL"
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want = rows_of([d[0] for d in result.description], result.fetchall())
    kinds = {n: KINDS.get(t, t) for n, t in types.items()}
    if kinds != dict(df.dtypes):
        return False, f"types {dict(df.dtypes)} / {types}"
    if got == want:
        return True, f"{len(got[1])} rows"
    detail = f"columns {got[0]} / {want[0]} rows {len(got[1])} / {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            detail += f"\n    spark {a}\n    sql   {b}"
            break
    return False, detail + f"\n    {dict(df.dtypes)} / {types}"


def main():
    from pyspark.sql import SparkSession

    from sparkseries.plans import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("CHECK_ZONE", "UTC"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, detail = compare(spark, con, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception:  # report and go on with the next query
            ok, detail = False, traceback.format_exc()[-1500:]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {detail}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
