"""Run catalog queries and their SQL twins side by side and compare values."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()

    def cell(value):
        if value is None:
            return "null"
        if isinstance(value, float):
            return repr(value + 0.0)
        if isinstance(value, bool):
            return str(value)
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tickweave.session import local_session

    if os.environ.get("SMALL_BINS"):
        from tickweave.operators.spread import Spread
        from tickweave.plans import catalog

        catalog.SPREAD = Spread(min_rows=40, rows_per_bin=15, max_groups=1000)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("SESSION_ZONE", "UTC"))
    con = connect(folder)
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            got = query(spark, folder).toPandas()
            sql = entry.oracle_sql().get(name)
            note = "no twin" if sql is None else compare(got, con.execute(sql).df()) or "ok"
        except Exception as problem:  # noqa: BLE001
            got, note = [], f"{type(problem).__name__}: {str(problem)[:1500]}"
        failed += note not in ("ok", "no twin")
        print(f"{name:24} {len(got):7} rows {time.time() - began:6.2f}s  {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
