"""Compare registered queries with their SQL twins on one scale factor.

Usage: python tests/oracle.py SF_DIR [name ...]
"""

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return f"i{v}"
    if isinstance(v, (float, decimal.Decimal)):
        return f"f{round(float(v), 6)}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    """Empty string when equal, else what differs."""
    df = fn(spark, sf)
    got, gcols = normal([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return "", len(got)
    start = time.time()
    cur = con.execute(sql)
    want, wcols = normal(cur.fetchall(), [c[0] for c in cur.description])
    if time.time() - start > 5:
        print(f"slow SQL: {name} {time.time() - start:.1f}s")
    if gcols != wcols:
        return f"columns {gcols} != {wcols}", len(got)
    if got == want:
        return "", len(got)
    g, w = set(got), set(want)
    return (f"{len(got)} rows vs {len(want)}; only spark {sorted(g - w)[:3]}; "
            f"only sql {sorted(w - g)[:3]}"), len(got)


def main():
    from pyspark.sql import SparkSession

    from siftline.catalog import QUERIES, SQL

    sf, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            diff, n = compare(spark, con, sf, name, fn, SQL.get(name))
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += bool(diff)
        kind = "sql" if name in SQL else "rows"
        print(f"{'BAD' if diff else 'ok '} {name} [{kind}] rows={n} {time.time() - start:.1f}s "
              f"{diff[:900]}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
