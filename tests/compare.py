"""Compare catalogue queries with their SQL on DuckDB.

``python tests/compare.py [sf_dir] [name prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
                out.append("<null>")
            elif isinstance(v, (float, np.floating)):
                out.append(repr(float(v)))
            elif isinstance(v, pd.Timestamp):
                out.append(v.isoformat())
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal, otherwise a short description."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    kinds = {
        c: (spark_df[c].dtype.kind, sql_df[c].dtype.kind)
        for c in spark_df.columns
        if spark_df[c].dtype.kind != sql_df[c].dtype.kind
    }
    if kinds:
        return f"types {kinds}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}"


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = make_session(), oracle(sf_dir)
    sqls = entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sqls:
                verdict = difference(got, con.execute(sqls[name]).df()) or "ok"
            else:
                verdict = "rows only"
            print(f"{name:28s} {len(got):8d} rows {t1 - t0:6.2f}s {time.time() - t1:6.2f}s {verdict}", flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"error {type(e).__name__}: {str(e)[:600]}"
            print(f"{name:28s} {verdict}", flush=True)
        if verdict not in ("ok", "rows only"):
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
