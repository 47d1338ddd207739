"""Run registered queries against their SQL in DuckDB: ``python tools/compare.py [sf_dir] [name…]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fieldloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        f = round(float(v), 6)
        return str(int(f)) if f == int(f) else repr(f)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - t0
    if sql is None:
        return f"rows-only {name}: {len(got)} rows {took:.1f}s", bool(got)
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    sql_took = time.time() - t0
    if got_cols != want_cols:
        return f"COLUMNS {name}: {got_cols} vs {want_cols}", False
    if got == want:
        return f"ok {name}: {len(got)} rows {took:.1f}s (sql {sql_took:.1f}s)", len(got) > 0
    got_set, want_set = set(got), set(want)
    extra = [r for r in got if r not in want_set][:2]
    lack = [r for r in want if r not in got_set][:2]
    return f"DIFF {name}: {len(got)} vs {len(want)}\n  cols {got_cols}\n  spark {extra}\n  sql   {lack}", False


def main(argv):
    from importlib import import_module
    from fieldloom import catalog

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    sections = [a[1:] for a in argv[1:] if a.startswith("@")]
    if sections:
        catalog.SECTIONS[:] = sections
    names = [a for a in argv[1:] if not a.startswith("@")]
    queries, oracles = catalog.all_queries(), catalog.all_oracles()
    spark, con = local_session("compare"), connect(sf_dir)
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        try:
            message, good = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            message, good = f"ERROR {name}: {str(e)[:1500]}", False
        bad += not good
        print(message, flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
