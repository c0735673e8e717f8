"""Compare registered queries with their SQL equivalents.

    python -m tests.oracle [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DEFAULT = "/root/testdata/sf0.01"


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tamis")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(table: pa.Table) -> tuple[list, list]:
    """Column names with types, and sorted rows."""
    names = sorted(table.column_names)
    kinds = [(n, _kind(table.schema.field(n).type)) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_value(v) for v in row) for row in zip(*columns)]
    return kinds, sorted(rows, key=repr)


def _kind(t: pa.DataType) -> str:
    return "string" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def compare(spark: SparkSession, con, name: str, folder: str, queries: dict, sql: dict) -> tuple[str, int, float]:
    """('' or the difference, rows, seconds)."""
    start = time.time()
    got = queries[name](spark, folder).toArrow()
    seconds = time.time() - start
    if name not in sql:
        return ("" if got.num_rows else "no rows"), got.num_rows, seconds
    want = con.sql(sql[name])
    want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.arrow()
    got_kinds, got_rows = canonical(got)
    want_kinds, want_rows = canonical(want)
    if got_kinds != want_kinds:
        return f"schema {got_kinds} instead of {want_kinds}", got.num_rows, seconds
    if got_rows != want_rows:
        wrong = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
        return f"{len(got_rows)} rows instead of {len(want_rows)}; differing: {len(wrong)} {wrong[:3]}", got.num_rows, seconds
    return "", got.num_rows, seconds


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    folder = argv.pop(0) if argv and "/" in argv[0] else DEFAULT
    queries, sql = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(folder)
    bad = 0
    for name in argv or queries:
        try:
            difference, rows, seconds = compare(spark, con, name, folder, queries, sql)
        except Exception as error:  # noqa: BLE001 - report and go on
            difference, rows, seconds = f"{type(error).__name__}: {str(error)[:600]}", -1, 0.0
        bad += bool(difference)
        mark = "DIFF" if difference else ("ok" if name in sql else "rows")
        print(f"{mark:5}{name:34}{rows:8} rows {seconds:7.2f}s {difference}", flush=True)
    print(f"{bad} differing of {len(argv or queries)}; {len(sql)} of {len(queries)} queries have SQL")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(sys.argv[1:]), 1))
