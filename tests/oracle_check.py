"""Compare every named query with its SQL: ``python tests/oracle_check.py [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or v is pd.NaT:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if isinstance(v, (list, dict, tuple)):
            return repr(v)
        return v

    rows = [tuple(cell(v) for v in row) for row in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def kinds(pdf: pd.DataFrame) -> dict[str, str]:
    return {c: str(pdf[c].dtype).replace("[ns]", "[us]") for c in sorted(pdf.columns)}


def compare(spark, con, name, entry, sf_dir):
    start = time.time()
    got = entry.run(spark, sf_dir).toPandas()
    took = time.time() - start
    if entry.sql is None:
        return "rows-only", f"{len(got)} rows", took
    want = con.execute(entry.sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return "COLUMNS", f"{sorted(got.columns)} != {sorted(want.columns)}", took
    if len(got) != len(want):
        return "ROWS", f"{len(got)} != {len(want)}", took
    a, b = canonical(got), canonical(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return "VALUES", str(diff)[:600], took
    note = "" if kinds(got) == kinds(want) else f" types {kinds(got)} {kinds(want)}"
    return "ok", f"{len(got)} rows{note}", took


def main() -> int:
    from tidemark.plans.registry import load_all
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("oracle"), duck(sf_dir)
    bad = 0
    for name, entry in load_all().items():
        if only and name not in only:
            continue
        try:
            verdict, note, took = compare(spark, con, name, entry, sf_dir)
        except Exception as e:  # report and go on
            verdict, note, took = "ERROR", str(e)[:900], 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{verdict:10s} {name:34s} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
