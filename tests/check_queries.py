"""Run registered queries against their SQL texts: ``python tests/check_queries.py [sf_dir] [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql):
    """(exact, close, message)"""
    names, rows = canonical(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    res = con.execute(sql)
    onames, orows = canonical([d[0] for d in res.description], res.fetchall())
    if names != onames:
        return False, False, f"columns {names} != {onames}"
    if len(rows) != len(orows):
        return False, False, f"rows {len(rows)} != {len(orows)}"
    if rows == orows:
        return True, True, f"{len(rows)} rows"

    def near(a, b):
        if isinstance(a, tuple) and isinstance(b, tuple):
            return len(a) == len(b) and all(near(x, y) for x, y in zip(a, b))
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
        return a == b

    bad = [(a, b) for a, b in zip(rows, orows) if not near(a, b)]
    diff = [(a, b) for a, b in zip(rows, orows) if a != b]
    return False, not bad, f"{len(rows)} rows, {len(diff)} differ, first {diff[0]}"


def main() -> int:
    from softgrove.session import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session("8")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                exact, close, msg = compare(df, con, oracles[name])
                state = "ok" if exact else ("NEAR" if close else "FAIL")
            else:
                msg, state = f"{len(df.collect())} rows", "rows"
        except Exception as e:  # noqa: BLE001
            state, msg = "ERROR", str(e)[:600]
        failed += state in ("FAIL", "ERROR", "NEAR")
        print(f"{state:5} {name:28} {time.time() - start:6.2f}s {msg}", flush=True)
    print(f"{failed} failed; without SQL: {sorted(set(queries) - set(oracles))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
