"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/compare.py SF [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if frame[column].isna().any():
            frame = frame.assign(**{column: [None if pd.isna(x) else str(x).removesuffix(".0") for x in frame[column]]})
        elif frame[column].dtype.kind in "iu":
            frame = frame.assign(**{column: frame[column].astype("int64")})
    return frame.sort_values(list(frame.columns), ignore_index=True)


def check(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    got = normal(entry.queries()[name](spark, sf_dir).toPandas())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    want = normal(con.execute(sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=True, check_exact=True)
    return f"equal: {len(got)}"


def main() -> None:
    sf, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        start = time.time()
        try:
            outcome = check(spark, con, name, sf_dir)
        except Exception as error:  # report every query, then fail
            bad.append(name)
            outcome = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:40s} {time.time() - start:6.1f}s  {outcome}", flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
