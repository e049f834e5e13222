"""Run registered queries next to their SQL in DuckDB: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    columns, rows = as_rows(df.columns, df.collect())
    if sql is None:
        return None if rows else "no rows"
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    wide = [c for c, t in types.items() if t in ("HUGEINT", "UBIGINT") or t.startswith("DECIMAL")]
    want_columns, want = as_rows(rel.columns, rel.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:2]
        missing = [r for r in want if r not in set(rows)][:2]
        return f"{len(rows)} vs {len(want)} rows; only here {str(extra)[:600]}; only there {str(missing)[:600]}"
    if wide:
        return f"equal, but cast {wide} in the SQL"
    return None if rows else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as e
    from presswork.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(e.queries())
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, e.queries()[name], e.oracle_sql().get(name))
        except Exception:
            problem = traceback.format_exc()[-1500:]
        bad += problem is not None
        kind = "sql" if name in e.oracle_sql() else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name}", problem or "", flush=True)
    print("bad:", bad, "of", len(names))
