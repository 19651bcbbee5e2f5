"""Run registered queries against their SQL twins: python tests/check_queries.py [names...]"""

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_mod  # noqa: E402
from hotspark import get_spark  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t
    if sql is None:
        return f"rows={len(got)}", dt, 0.0, True
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    dq = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", dt, dq, False
    types_s = {f.name: f.dataType.simpleString() for f in df.schema}
    types_d = {d[0]: str(d[1]) for d in cur.description}
    want_type = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}
    bad_types = {c: (types_s[c], types_d[c]) for c in cols if want_type.get(types_s[c], "?") != types_d[c]}
    g, w = rows_of(df.columns, got), rows_of(cols, want)
    note = f"rows={len(g)}"
    ok = g == w
    if bad_types:
        note += f" TYPES {bad_types}"
        ok = False
    if len(g) == 0:
        note += " EMPTY"
    if g != w:
        diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
        note += f" MISMATCH spark={len(g)} duck={len(w)} cols={sorted(cols)} {diff}"
    return note, dt, dq, ok


def main():
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark("check", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                      spark_driver_memory="8g", spark_checkpoint_dir=tempfile.mkdtemp(prefix="queries-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    names = [n for a in sys.argv[1:] for n in q if n == a or (a.endswith("*") and n.startswith(a[:-1]))] or list(q)
    bad = 0
    for n in names:
        try:
            note, dt, dq, ok = compare(spark, con, n, q[n], o.get(n), sf)
        except Exception as e:  # noqa: BLE001
            note, dt, dq, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0, 0, False
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {'O' if n in o else 'R'} {n:28s} {dt:6.2f}s duck {dq:5.2f}s {note}", flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main()
