"""Compare registered queries with their SQL on a second engine.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _kind(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def _text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(f"{_kind(r[i])}:{_text(r[i])}" for i in order) for r in rows)


def compare(spark, db, name, query, sql, folder):
    """None when equal, else a short description of the first difference."""
    df = query(spark, folder)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    other = canonical(names, result.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} <> {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"rows {len(mine[1])} <> {len(other[1])}"
    for a, b in zip(mine[1], other[1]):
        if a != b:
            return f"\n   spark  {a}\n   oracle {b}"
    return None


def main(argv):
    from precinct.plans.registry import ORACLES, QUERIES
    from precinct.session import build_session
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                found = compare(spark, db, name, QUERIES[name], ORACLES[name], folder)
            else:
                rows = QUERIES[name](spark, folder).collect()
                found = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        mark = "ok  " if found is None else "FAIL"
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s {'' if name in ORACLES else '(rows only) '}{found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} queries agree")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
