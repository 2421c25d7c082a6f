"""Runs registered queries against their check statements."""
from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def session():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("quarterdeck")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return len(got) > 0, f"rows {len(got)} {took:.1f}s"
    rel = con.sql(sql)
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of(rel.columns, rel.fetchall())
    if a_names != b_names:
        return False, f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return False, f"rows {len(a)} != {len(b)} e.g. {extra}"
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return False, f"{len(bad)}/{len(a)} differ, columns {a_names}: {bad[0]}"
    return len(a) > 0, f"rows {len(a)} {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    picks = sys.argv[1:]
    spark, con, checks, bad = session(), connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            ok, message = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as e:
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, message if ok or len(message) < 1500 else message[:1500], flush=True)
    print("failed:", bad)
