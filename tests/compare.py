"""Run registered queries against their SQL twins:  python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_rows, sql_rows) -> str:
    if len(spark_rows) != len(sql_rows):
        return f"row count {len(spark_rows)} vs {len(sql_rows)}"
    if spark_rows == sql_rows and repr(spark_rows) == repr(sql_rows):
        return "exact"
    bad = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if not bad:
        return "exact (types differ)"
    return f"{len(bad)} rows differ, first: {bad[0][0]} vs {bad[0][1]}"


def check(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    spark_rows = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(spark_rows)}"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    types = [str(d[1]) for d in result.description]
    verdict = compare(spark_rows, rows_of(names, result.fetchall()))
    wide = [t for t in types if "HUGEINT" in t or "DECIMAL" in t]
    return verdict + (f" [sql types {wide}]" if wide else "") + f" n={len(spark_rows)}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from riskloom.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            result = check(spark, con, folder, fn, sqls.get(name))
        except Exception as e:
            result = "ERROR " + str(e).split("JVM stacktrace")[0][:700]
        ok = result.startswith(("exact", "rows only"))
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:38s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)
