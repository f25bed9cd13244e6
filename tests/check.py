"""Runs registered queries next to their SQL:  python tests/check.py SF_DIR [name ...]"""

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0) if v != int(v) or math.isinf(v) else repr(float(v) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def kinds(types):
    out = []
    for t in types:
        t = str(t).lower()
        for a, b in (("bigint", "int"), ("integer", "int"), ("hugeint", "int"), ("varchar", "string"), ("timestamp_ntz", "timestamp")):
            t = t.replace(a, b)
        out.append(t)
    return out


def compare(spark, con, sf, name, plan, sql):
    t0 = time.time()
    df = plan(spark, sf)
    got = df.collect()
    spent = time.time() - t0
    if sql is None:
        return spent, len(got), None, ""
    rel = con.sql(sql)
    want = rel.fetchall()
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(rel.columns, want)
    note = ""
    if ca != cb:
        note = f"columns {ca} / {cb}"
    elif a != b:
        sa, sb = set(a), set(b)
        note = f"rows {len(a)} / {len(b)}; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}"
    types = dict(df.dtypes)
    ta = kinds([types[c] for c in ca])
    tb = kinds([dict(zip(rel.columns, rel.types))[c] for c in cb]) if ca == cb else []
    diff = [(c, x, y) for c, x, y in zip(ca, ta, tb) if x != y]
    return spent, len(got), not note, note + (f" types {diff}" if diff else "")


def main(sf, names):
    from codeloom.plans.registry import load_all
    from codeloom.session import local_session

    spark, con = local_session(8), duck(sf)
    bad = 0
    for name, q in load_all().items():
        if names and name not in names:
            continue
        try:
            spent, n, same, note = compare(spark, con, sf, name, q.plan, q.sql)
        except Exception as e:  # a failing query must not hide the others
            spent, n, same, note = 0.0, 0, False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += same is False
        state = "rows-only" if same is None else "ok" if same else "DIFFERENT"
        print(f"{name:34s} {state:10s} rows={n:7d} {spent:6.2f}s {note[:1500]}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
