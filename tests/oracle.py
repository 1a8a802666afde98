"""Holds queries against their SQL in DuckDB: python -m tests.oracle [NAME...] (SF_DIR names the tables)."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def session() -> SparkSession:
    os.environ["PYTHONPATH"] = ROOT
    b = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if got != want:
        k = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return f"{len(got)} and {len(want)} rows; row {k}: {got[k : k + 1]} and {want[k : k + 1]}"
    return ""


def main(names: list[str]) -> int:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    spark, con, bad = session(), connection(SF_DIR), 0
    every, sql = e.queries(), e.oracle_sql()
    for n in names or every:
        t = time.time()
        try:
            said = compare(spark, con, every[n], sql[n], SF_DIR) if n in sql else f"-- no SQL; {every[n](spark, SF_DIR).count()} rows"
        except Exception as x:  # noqa: BLE001  said with its name; the next one goes on
            said = f"{type(x).__name__}: {str(x)[:400]}"
        bad += bool(said) and not said.startswith("--")
        print(f"{'OK ' if not said else '   ' if said.startswith('--') else 'BAD'} {n} {time.time() - t:.1f} s {said}"[:900], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
