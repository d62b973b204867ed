"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v


def frame_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(_norm(v) for v in r)) for r in df[cols].itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def compare(name, spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"rows differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    hs, hd = frame_hash(spark_pdf), frame_hash(duck_pdf)
    if hs != hd:
        cols = sorted(spark_pdf.columns)
        a = sorted(repr(tuple(_norm(v) for v in r)) for r in spark_pdf[cols].itertuples(index=False, name=None))
        b = sorted(repr(tuple(_norm(v) for v in r)) for r in duck_pdf[cols].itertuples(index=False, name=None))
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"value hash differs; cols={cols}; first diffs: {diff}"
    return True, "ok"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    from tabsmith.session import local_session
    import __spark_entry__ as E
    spark = local_session()
    con = duck(sf_dir)
    qs, sql = E.queries(), E.oracle_sql()
    ok = bad = 0
    oracle_only = os.environ.get("ORACLE_ONLY") == "1"
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if oracle_only and name not in sql:
            continue
        if os.environ.get("ROWS_ONLY") == "1" and name in sql:
            continue
        t = time.time()
        try:
            spdf = fn(spark, sf_dir).toPandas()
        except Exception:
            bad += 1
            print(f"FAIL {name}: spark error\n{traceback.format_exc()[-2500:]}")
            continue
        st = time.time() - t
        if name not in sql:
            print(f"ROWS {name}: {len(spdf)} rows, {st:.1f}s (no oracle)")
            ok += 1
            continue
        try:
            dpdf = con.execute(sql[name]).df()
        except Exception:
            bad += 1
            print(f"FAIL {name}: duckdb error\n{traceback.format_exc()[-1500:]}")
            continue
        good, msg = compare(name, spdf, dpdf)
        ok += good
        bad += not good
        print(f"{'PASS' if good else 'FAIL'} {name}: {len(spdf)} rows, {st:.1f}s {'' if good else msg}")
    print(f"\n{ok} ok, {bad} failed")
    spark.stop()
    return 0 if bad == 0 else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
