import duckdb
import pytest
from pyspark.sql import SparkSession

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()

    def rows(sql):
        return con.execute(sql).fetchall()

    return rows


@pytest.fixture
def frame(spark):
    """Documents with the columns the operators might use for themselves."""

    def make(rows, schema="doc_id long, text string, lang string, source string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("key", "sha", "copies", "kept", "digest", "hash", "fp", "label", "score", "n"):
            if name not in df.columns:
                df = df.selectExpr("*", f"cast(null as string) as `{name}`")
        return df

    return make
