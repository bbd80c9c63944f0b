"""Run registered Spark queries and their DuckDB oracles side by side.

    python -m tests.oracle [--sf DIR] [name ...]

Compares row count, column names, column type families and values
(order-insensitive, doubles to 2e-9).  Used by tests/test_oracle.py too.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _spark_kind(dt) -> str:
    if isinstance(dt, T.LongType):
        return "bigint"
    if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return dt.simpleString()


def _duck_kind(t: str) -> str:
    t = t.upper()
    return {"BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "int", "DOUBLE": "double",
            "FLOAT": "double", "VARCHAR": "string", "BOOLEAN": "bool"}.get(t, t.lower())


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    """Sort key: exact columns first, so that the last digits of a double cannot part two equal rows."""
    exact = tuple((0, "") if x is None else (1, repr(x)) for x in row if not isinstance(x, float))
    return exact, tuple(x for x in row if isinstance(x, float))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = [f.name for f in sdf.schema.fields]
    s_kinds = {f.name: _spark_kind(f.dataType) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": True, "rows": len(s_rows), "spark_s": t1 - t0, "oracle": False}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    d_kinds = {d[0]: _duck_kind(str(d[1])) for d in res.description}
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark-only {sorted(set(s_cols)-set(d_cols))} "
                        f"duck-only {sorted(set(d_cols)-set(s_cols))}")
    else:
        kd = [(c, s_kinds[c], d_kinds[c]) for c in s_cols if s_kinds[c] != d_kinds[c]]
        if kd:
            problems.append(f"types differ: {kd}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows differ: spark {len(s_rows)} duck {len(d_rows)}")
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        a = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
        b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
        bad = 0
        first = None
        for x, y in zip(a, b):
            for c, u, v in zip(order, x, y):
                if u == v:
                    continue
                if isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-9 * max(1e-3, abs(v)) + 1.1e-9:
                    continue
                bad += 1
                if first is None:
                    first = (c, u, v, x, y)
                break
        if bad:
            problems.append(f"{bad} rows differ; first: col={first[0]} spark={first[1]!r} "
                            f"duck={first[2]!r}\n   spark row={first[3]}\n   duck row ={first[4]}")
    return {"name": name, "ok": not problems, "rows": len(s_rows), "spark_s": t1 - t0,
            "oracle": True, "problems": problems}


def main(argv):
    sf = "/root/testdata/sf0.01"
    names = []
    it = iter(argv)
    for a in it:
        if a == "--sf":
            sf = next(it)
        else:
            names.append(a)
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from flowlab.session import build_session
    spark = build_session("local[8]")
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf)
    sel = [n for n in q if not names or any(n.startswith(p) for p in names)]
    fails = 0
    for n in sel:
        try:
            r = compare(spark, con, n, q[n], o.get(n), sf)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "ok": False, "problems": [f"{type(e).__name__}: {str(e)[:800]}"],
                 "rows": -1, "spark_s": 0, "oracle": n in o}
        tag = "OK  " if r["ok"] else "FAIL"
        kind = "sql " if r["oracle"] else "rows"
        print(f"{tag} {kind} {n:32s} rows={r['rows']:<7} {r['spark_s']:.2f}s", flush=True)
        for p in r.get("problems", []):
            print("     ", p)
        fails += not r["ok"]
    print(f"{len(sel) - fails}/{len(sel)} ok; {sum(1 for n in sel if n in o)} with SQL oracle")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
