"""Run queries against their SQL on the same tables and report differences."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return None if v != v else round(float(v), 9)
    if type(v).__name__.startswith("int"):
        return int(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> list[str]:
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = _rows(names, cur.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        problems.append(f"{len(a - b)} only in spark e.g. {sorted(a - b)[:2]}")
        problems.append(f"{len(b - a)} only in sql e.g. {sorted(b - a)[:2]}")
        types = {type(x) for r in mine[:50] for x in r} ^ {type(x) for r in theirs[:50] for x in r}
        problems.append(f"types {types}")
    return problems or ([] if mine else ["note: no rows"])


if __name__ == "__main__":
    import __spark_entry__ as E
    from timberline.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 and sys.argv[2] else None
    spark, con = local_session(), connect(sf)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in o:
                issues = compare(spark, con, fn, o[name], sf)
            else:
                df = fn(spark, sf)
                n = len(df.collect())
                issues = [f"note: unchecked, {n} rows"]
        except Exception as e:  # noqa: BLE001
            issues = [f"{type(e).__name__}: {str(e)[:900]}"]
        fail = [i for i in issues if not i.startswith("note")]
        bad += bool(fail)
        print(f"{'FAIL' if fail else 'ok  '} {name} {time.time() - t:.1f}s", *[i[:1200] for i in issues], flush=True)
    print("failures:", bad)
