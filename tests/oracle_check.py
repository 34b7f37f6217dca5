"""Run Spark queries and their DuckDB oracle side by side and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.date() if v == v.normalize() else v.to_pydatetime()
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
          "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    st = {c: _TYPES.get(t, t) for c, t in sdf.dtypes}
    dt = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if st != dt:
        diff = sorted((c, st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c))
        return False, f"{name}: TYPES differ {diff}"
    s = sdf.toPandas()
    t1 = time.time()
    d = con.execute(sql).df()
    t2 = time.time()
    info = f"{name}: spark {len(s)} rows {t1-t0:.1f}s, duck {len(d)} rows {t2-t1:.1f}s"
    if sorted(s.columns) != sorted(d.columns):
        return False, info + f" COLUMNS differ {sorted(s.columns)} vs {sorted(d.columns)}"
    if len(s) != len(d):
        return False, info + " ROWCOUNT differs"
    a, b = frame_rows(s), frame_rows(d)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, info + f" VALUES differ ({len(bad)}), first: {bad[0]}"
    return True, info


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from exposa.session import get_spark
    from exposa.plans.catalog import ORACLE, QUERIES
    spark = get_spark()
    con = duck(sf_dir)
    ok_all = True
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        if name not in ORACLE:
            try:
                t0 = time.time()
                n = fn(spark, sf_dir).count()
                print(f"ROWS {name}: no oracle, {n} rows {time.time() - t0:.1f}s", flush=True)
            except Exception as e:  # noqa: BLE001
                ok_all = False
                print(f"FAIL {name}: ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        try:
            ok, info = compare(spark, con, name, fn, ORACLE[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        ok_all &= ok
        print(("OK   " if ok else "FAIL ") + info, flush=True)
    sys.exit(0 if ok_all else 1)


if __name__ == "__main__":
    main()
