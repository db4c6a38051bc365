"""Run catalog queries in Spark and their DuckDB oracle; compare results.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from stancekit.plans import catalog  # noqa: E402
from stancekit.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _canon(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.QUERIES_LOADED()
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:1500]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = catalog.ORACLE.get(name)
        if sql is None:
            print(f"rows-only {name}: {len(srows)} rows {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:1500]}")
            bad += 1
            continue
        td = time.time() - t1
        if sorted(scols) != sorted(dcols):
            print(f"COLS {name}: spark={scols} duck={dcols}")
            bad += 1
            continue
        tmap = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
        stypes = {f.name: tmap.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dtypes = dict(zip(dcols, [str(t) for t in con.sql(sql).types]))
        if stypes != dtypes:
            print(f"TYPES {name}: spark={stypes} duck={dtypes}")
            bad += 1
            continue
        a, b = rows_of(scols, [tuple(r) for r in srows]), rows_of(dcols, drows)
        if a == b:
            print(f"ok {name}: {len(a)} rows spark {ts:.1f}s duck {td:.1f}s")
        else:
            bad += 1
            print(f"DIFF {name}: spark {len(a)} rows, duck {len(b)} rows; cols={sorted(scols)}")
            sa, sb = set(a), set(b)
            print("  only spark:", list(sa - sb)[:3])
            print("  only duck :", list(sb - sa)[:3])
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
