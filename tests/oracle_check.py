"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _clean(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if v != v:
            return None
        return f"{v:.6f}" if v else "0.000000"
    return str(v)


def normalised(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_clean(r[i]) for i in order) for r in rows), key=lambda r: tuple(x or "" for x in r))


def compare(spark_df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    mine = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = normalised(mine, spark_df.columns), normalised(theirs, names)
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb, key=str)[:2], sorted(sb - sa, key=str)[:2]
    return f"{len(a)} rows != {len(b)}; spark {only_a} sql {only_b} ({len(sa - sb)} differ)"


def main() -> None:
    import __spark_entry__ as e
    from affinis import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session.build(
        "local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            out = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as err:
            out = f"ERROR {type(err).__name__} {str(err)[:600]}"
        ok = not out or out.startswith("rows only: ")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {out}", flush=True)
    print("missing queries:", sorted(set(sql) - set(e.queries())))
    print("bad:", bad)


if __name__ == "__main__":
    main()
