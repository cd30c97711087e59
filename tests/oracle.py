"""Run a registered query and its SQL twin on the same tables and compare rows."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, int):
        return ("i", str(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", str([canon(x) for x in v]))
    return ("s", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canon(row[i]) for i in order) for row in rows)


def compare(con, spark, folder, fn, sql):
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        a, b = bad[0]
        cols = [(n, x, y) for n, x, y in zip(got[0], a, b) if x != y]
        return f"{len(bad)} of {len(want[1])} rows differ, e.g. {cols}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from tidemark.catalog import ORACLE, QUERIES
    from tidemark.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            if name in ORACLE:
                res = compare(con, spark, folder, fn, ORACLE[name]) or "ok"
            else:
                df = fn(spark, folder)
                rows = df.collect()
                res = f"rows-only {len(rows)} {rows[:3]}"
        except Exception as e:
            lines = [x for x in str(e).splitlines() if x.strip()]
            res = f"ERROR {type(e).__name__} {' / '.join(lines[:4])[:900]}"
        print(f"{name:32s} {time.time() - t:6.1f}s {res}", flush=True)
