"""Run registered queries in Spark and their SQL in DuckDB, and compare.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf, name, fn, sql):
    """None when both agree on some rows, else a description of the difference."""
    df = fn(spark, sf)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    want = rows(columns, cur.fetchall())
    if got == want:
        return None if got else "no rows"
    a, b = set(got) - set(want), set(want) - set(got)
    return (
        f"rows {len(got)} / {len(want)}, only spark {len(a)}, only sql {len(b)}\n"
        f"      spark {str(sorted(a)[:2])[:600]}\n      sql   {str(sorted(b)[:2])[:600]}"
    )


def main(sf, names):
    from conftest import session

    import __spark_entry__ as e

    spark, con, sql = session(), duck(sf), e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sql:
                diff = compare(spark, con, sf, name, fn, sql[name])
            else:
                diff = None if fn(spark, sf).count() else "no rows"
        except Exception as ex:  # report and go on with the next query
            diff = f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
