"""Run queries on Spark and their check in DuckDB, and compare the sorted rows."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        assert not math.isnan(v) and not math.isinf(v), "NaN or Inf in a result"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row))


def compare(spark, con, name, queries, oracles, path) -> dict:
    began = time.time()
    df = queries[name](spark, path)
    got = df.collect()
    spark_s = time.time() - began
    gn, gr = _rows(df.columns, [tuple(x) for x in got])
    out = {"name": name, "rows": len(gr), "spark_s": round(spark_s, 2), "ok": True, "why": ""}
    if name not in oracles:
        out.update(ok=False, why="no check")
        return out
    began = time.time()
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    out["duck_s"] = round(time.time() - began, 2)
    wn, wr = _rows(names, rows)
    if gn != wn:
        out.update(ok=False, why=f"columns {gn} != {wn}")
    elif len(gr) != len(wr):
        out.update(ok=False, why=f"rows {len(gr)} != {len(wr)}; first {gr[:2]} / {wr[:2]}")
    else:
        bad = [(a, b) for a, b in zip(gr, wr) if a != b]
        if bad:
            out.update(ok=False, why=f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}")
        else:
            for i, n in enumerate(gn):
                kinds = {_kind(row[i]) for row in gr if row[i] is not None}, {_kind(row[i]) for row in wr if row[i] is not None}
                if kinds[0] != kinds[1]:
                    out.update(ok=False, why=f"types of {n}: {kinds}")
    return out
