"""Run registered queries against their oracle SQL and print differences.

Usage: python tests/check_oracles.py [name-part ...]   (SF_DIR and CHUNK_ROWS are read from the environment)
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

#: Tables of the tests.
SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else a short description."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} vs {names}"
    perm = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in perm) for r in want]
    odd = [f"{n}:{t}" for n, t in zip(names, types) if t in ("HUGEINT", "INTEGER", "UBIGINT") or t.startswith("DECIMAL")]
    note = f" types {odd}" if odd else ""
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}" + note
    got.sort(key=lambda r: tuple(_key(v) for v in r))
    want.sort(key=lambda r: tuple(_key(v) for v in r))
    bad = [(g, w) for g, w in zip(got, want) if not all(_same(a, b) for a, b in zip(g, w))]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}" + note
    exact = sum(1 for g, w in zip(got, want) if g != w)
    if exact:
        g, w = next((g, w) for g, w in zip(got, want) if g != w)
        note += f" inexact {exact} {[(a, b) for a, b in zip(g, w) if a != b]}"
    if not got:
        note += " EMPTY"
    return note


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b)) + 1.01e-6
    return a == b


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidewater.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    if os.environ.get("CHUNK_ROWS"):
        spark.conf.set("tidewater.chunk.rows", os.environ["CHUNK_ROWS"])
    con, oracles, failed = connect(folder), oracle_sql(), []
    parts = sys.argv[1:]
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            msg = compare(df, con, oracles[name]) if name in oracles else f" rows-only {df.count()}"
        except Exception as e:  # report and go on with the next query
            msg = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        ok = not msg or msg.startswith(" ")
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
