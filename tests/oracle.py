"""Holds registered queries against their SQL, run by DuckDB on the same files."""

import glob
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def differences(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns), (sorted(names), sorted(got.columns))
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, cur.fetchall())
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{len(a)} and {len(b)} rows; {diff}"
    return None


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    q, o = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or [n for n in q if not n.startswith("op") and n != "pipeline"]:
        t = time.time()
        try:
            if n in o:
                said = differences(s, q[n], o[n], sf)
            else:
                said = None if q[n](s, sf).count() >= 0 else "no rows"
            print(f"{n}: {'ok' if said is None else 'DIFFERS ' + said[:500]} {time.time() - t:.1f}s" + ("" if n in o else " (rows only)"), flush=True)
        except Exception as x:
            print(f"{n}: FAILED {type(x).__name__} {str(x)[:500]}", flush=True)
