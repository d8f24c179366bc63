"""Compare Spark queries with their DuckDB counterparts on the given tables.

Usage: python tests/oracle.py SF_DIR [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


FAMILY = {"INTEGER": "int", "BIGINT": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
SPARK_FAMILY = {"int": "int", "bigint": "int", "double": "double", "string": "string", "boolean": "boolean"}


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, str)):
        return value
    f = float(value)
    return None if math.isnan(f) else round(f, 9) + 0.0


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), v if not isinstance(v, (int, float)) else float(v)) if v is not None else (True, "", "") for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str:
    """Empty string when equal."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    order = sorted(spark_cols)
    s_at, d_at = [spark_cols.index(c) for c in order], [duck_cols.index(c) for c in order]
    a = sorted((tuple(canonical(r[i]) for i in s_at) for r in spark_rows), key=sort_key)
    b = sorted((tuple(canonical(r[i]) for i in d_at) for r in duck_rows), key=sort_key)
    bad = [(x, y) for x, y in zip(a, b) if any(
        (p != q) and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and p == q) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} differ, first {order}: {bad[0]}" if bad else ""


def check(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[str, float, int]:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return "", seconds, len(rows)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    families = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in cur.description}
    for c, t in df.dtypes:
        if c in families and SPARK_FAMILY.get(t, t) != families[c]:
            return f"type of {c}: spark {t}, duckdb {families[c]}", seconds, len(rows)
    return compare([tuple(r) for r in rows], df.columns, cur.fetchall(), cols), seconds, len(rows)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from markertree.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session, con = local_session(), connect(sf)
    oracle = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, seconds, n = check(session, con, sf, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            problem, seconds, n = f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {seconds:6.2f}s rows={n}{'' if name in oracle else ' (no sql)'} {problem}", flush=True)
    print("failed:", failed)
