"""Runs a catalogued query and its SQL side by side and reports the difference."""

from __future__ import annotations

import math
import threading
import time
from pathlib import Path

import duckdb

from launchgrid.catalog import CATALOG

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL_SECONDS = 60


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, float):
        return f"f{v + 0.0!r}"
    if hasattr(v, "as_tuple"):
        return f"dec{v}"
    return f"{type(v).__name__[0]}{v}"


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    entry = CATALOG[name]
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if entry.sql is None:
        return len(got) > 0, f"rows only {len(got)} {t1 - t0:.1f}s"
    stop = threading.Timer(SQL_SECONDS, con.interrupt)
    stop.start()
    try:
        cur = con.execute(entry.sql)
        names = [c[0] for c in cur.description]
        want = cur.fetchall()
    finally:
        stop.cancel()
    t2 = time.time()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return False, f"columns {cols} vs {sorted(names)}"
    a = sorted(tuple(_plain(r[c]) for c in cols) for r in got)
    idx = [names.index(c) for c in cols]
    b = sorted(tuple(_plain(r[i]) for i in idx) for r in want)
    info = f"rows {len(a)}/{len(b)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    if a == b:
        return len(a) > 0, info
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{info} cols {cols} first differences {diff}"
