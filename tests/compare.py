"""Compare registered queries with their SQL on DuckDB. Also a script: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark_result, duck_result) -> str | None:
    """None when equal, else what differs."""
    (c1, r1), (c2, r2) = normal(*spark_result), normal(*duck_result)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows != {len(r2)}; e.g. {sorted(set(r1) ^ set(r2), key=repr)[:4]}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    return f"{len(bad)} rows differ; e.g. {bad[:2]}" if bad else None


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def main() -> None:
    import __spark_entry__ as entry
    from wardline.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or name.startswith(n + "*") or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(rows)} {took:.2f}s {rows[:1]}", flush=True)
                continue
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            diff = difference((df.columns, rows), (cols, cur.fetchall()))
            odd = [f"{f.name}:{f.dataType.simpleString()}/{types.get(f.name)}" for f in df.schema.fields if KINDS.get(types.get(f.name)) != f.dataType.simpleString()]
        except Exception as exc:  # noqa: BLE001
            diff, odd, rows, took = f"{type(exc).__name__}: {str(exc)[:600]}", [], [], time.time() - start
        bad += diff is not None
        print(f"{'ok   ' if diff is None else 'BAD  '} {name} {len(rows)} {took:.2f}s {'types ' + str(odd) if odd else ''} {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
