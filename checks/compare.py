"""Run queries against their SQL: ``python -m checks.compare [scale] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v is pd.NA or v != v else (float(v) if isinstance(v, float) else v) for v in row)
            for row in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf: str, name: str) -> str:
    """Empty when query and SQL agree; otherwise what differs."""
    got = QUERIES[name](spark, sf)
    mine = got.toPandas()
    if name not in ORACLES:
        return ""
    theirs = con.execute(ORACLES[name]).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    kinds = {c: (mine[c].dtype.kind, theirs[c].dtype.kind) for c in mine.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "O" not in k}
    a, b = canonical(mine), canonical(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows: {bad[:2]}"
    return f"types {odd}" if odd else ""


def main() -> None:
    args = sys.argv[1:]
    sf = f"/root/testdata/sf{args[0] if args else '0.01'}"
    names = args[1:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    for name in names:
        start = time.time()
        try:
            said = difference(spark, con, sf, name) or "ok"
        except Exception as e:
            said = "ERROR " + "".join(traceback.format_exception_only(e))[:600]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{name:26s} {time.time() - start:6.2f}s {'' if name in ORACLES else '(no SQL) '}{said}", flush=True)


if __name__ == "__main__":
    main()
