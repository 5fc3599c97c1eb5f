"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from factloom.plans.adapters import BASE_TABLES  # noqa: E402


def duck(folder: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    """Returns None when equal, else a short description of the difference; and the two timings."""
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    t1 = time.time()
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sql is None:
        return (None if got else "no rows"), len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]).lower() for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(cols, want)
    same = {"bigint": "bigint", "int": "integer", "string": "varchar", "double": "double", "boolean": "boolean"}
    notes = [f"{c}:{types[c]}/{dtypes[c]}" for c in gc if c in dtypes and same.get(types[c], types[c]) != dtypes[c]]
    if gc != wc:
        return f"columns {gc} vs {wc}", len(got), t1 - t0, t2 - t1
    if gr != wr:
        a, b = set(gr) - set(wr), set(wr) - set(gr)
        return (f"rows {len(gr)} vs {len(wr)}; only spark {len(a)} {sorted(a)[:2]}; only sql {len(b)} {sorted(b)[:2]}",
                len(got), t1 - t0, t2 - t1)
    if notes:
        return "types " + " ".join(notes), len(got), t1 - t0, t2 - t1
    return (None if got else "equal but empty"), len(got), t1 - t0, t2 - t1


def main(argv):
    from factloom.session import build_session
    import __spark_entry__ as entry_module
    folder = argv[0] if argv else "/root/testdata/sf0.001"
    picks = argv[1:]
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(folder), 0
    sqls = entry_module.oracle_sql()
    for name, fn in entry_module.queries().items():
        if picks and not any(name == p or (name.startswith(p) and not p[-1].isdigit()) or name.startswith(p + "_") for p in picks):
            continue
        try:
            problem, n, ts, td = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n, ts, td = f"{type(e).__name__}: {str(e)[:900]}", 0, 0, 0
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {name} [{kind}] rows={n} spark={ts:.1f}s duckdb={td:.1f}s"
              f"{'' if problem is None else '  ' + problem}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
