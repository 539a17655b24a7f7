"""Runs registered queries against their DuckDB oracle: ``python tests/compare.py [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "~null"
        if isinstance(v, float):
            return "~null" if math.isnan(v) else repr(round(v, 9) + 0.0)
        if hasattr(v, "item"):
            return one(v.item())
        return str(v)

    cols = sorted(pdf.columns)
    return sorted(tuple(one(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    # Row objects, since pandas would turn whole numbers with nulls into floats.
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    t1 = time.time()
    if sql is None:
        return "rows-only", f"{len(got)} rows", t1 - t0
    rel = con.execute(sql)
    want = rel.fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return "COLUMNS", f"{sorted(got.columns)} vs {sorted(want.columns)}", t1 - t0
    want_types = dict(zip(want.columns, [str(d[1]) for d in rel.description])) if rel.description else {}
    a, b = canon(got), canon(want)
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        only_a, only_b = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
        return "ROWS", f"{len(a)} vs {len(b)}\n   spark {str(only_a)[:600]}\n   duck  {str(only_b)[:600]}", t1 - t0
    if a != b:
        sa, sb = set(a), set(b)
        da, db = [x for x in a if x not in sb], [x for x in b if x not in sa]
        return "VALUES", f"{len(da)} of {len(a)}\n   spark {str(da[:2])[:900]}\n   duck  {str(db[:2])[:900]}", t1 - t0
    pairs = {
        "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    off = [
        f"{c}:{t}/{want_types.get(c)}" for c, t in df.dtypes
        if want_types.get(c) and pairs.get(t, t) not in want_types[c].upper()
    ]
    return ("ok" if not off else "TYPES"), f"{len(a)} rows {off or ''}", t1 - t0


def main() -> int:
    from galley.session import local_session
    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            status, note, sec = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - the report must go on
            status, note, sec = "ERROR", f"{type(exc).__name__}: {str(exc)[:1200]}", 0.0
        flag = status not in ("ok", "rows-only")
        bad += flag
        print(f"{'!!' if flag else '  '} {name:36s} {status:9s} {sec:5.1f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
