"""Run registered queries next to their DuckDB twins and compare rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return sorted(columns), out


def differences(spark, con, folder, fn, sql, limit=3):
    """Empty string when equal, otherwise what differs."""
    df = fn(spark, folder)
    cols, rows = normalise(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if rows else "no rows"
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    ocols, orows = normalise([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} vs {ocols}"
    if len(rows) != len(orows):
        return f"{len(rows)} rows vs {len(orows)}: {rows[:limit]} | {orows[:limit]}"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[:limit]}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {c: (t, kinds[c]) for c, t in df.dtypes if names.get(t, t) != kinds[c]}
    return f"types {types}" if types else ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("molspark-compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    import __spark_entry__ as entry

    spark, con = session(), connect(opts.sf)
    failed, qs, oracles = [], entry.queries(), entry.oracle_sql()
    for name in opts.names or qs:
        for full in [q for q in qs if q == name or (name.endswith("*") and q.startswith(name[:-1]))]:
            t = time.time()
            try:
                msg = differences(spark, con, opts.sf, qs[full], oracles.get(full))
            except Exception as e:  # report and go on
                msg = f"{type(e).__name__}: {str(e)[:600]}"
            mark = "ok" if not msg else "FAIL"
            if msg:
                failed.append(full)
            print(f"{mark:4} {time.time() - t:6.2f}s {'sql' if full in oracles else 'rows'} {full} {msg[:900]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
