"""Run registered queries on one data set and compare them with their SQL in DuckDB.

    python tools/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from wattline.plans.catalog import REGISTRY
from wattline.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(frame):
    """Column names and rows in a comparable order."""
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        rows.append(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in row))
    return list(frame.columns), sorted(rows)


def compare(spark, con, sf_dir: str, key: str) -> tuple[bool, str]:
    q = REGISTRY[key]
    start = time.time()
    got = q.run(spark, sf_dir).toPandas()
    spent = time.time() - start
    if q.sql is None:
        return len(got) > 0, f"rows-only {len(got)} rows, {spent:.1f}s"
    start = time.time()
    want = con.execute(q.oracle()).df()
    sql_s = time.time() - start
    a, b = canon(got), canon(want)
    note = f"{len(a[1])} rows, spark {spent:.1f}s, sql {sql_s:.1f}s"
    if a == b:
        return len(a[1]) > 0, note
    diff = [(x, y) for x, y in zip(a[1], b[1], strict=False) if x != y]
    types = [(str(got[c].dtype), str(want[c].dtype)) for c in a[0] if c in want.columns]
    return False, f"{note}; sql rows {len(b[1])}; cols {a[0]} vs {b[0]}; {len(diff)} differ; {diff[:2]}; {types}"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(REGISTRY)
    if len(keys) == 1 and keys[0].startswith("@"):
        keys = [k for k, q in REGISTRY.items() if q.build.__module__.endswith(keys[0][1:])]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for key in keys:
        try:
            ok, note = compare(spark, con, sf_dir, key)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1200]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + key, note, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
