"""Run queries against their DuckDB SQL: python -m tests.compare [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql.types import IntegerType, LongType

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides have the same columns, types and rows."""
    left, right = spark_df.toPandas(), con.execute(sql).df()
    for field in spark_df.schema:
        if isinstance(field.dataType, (IntegerType, LongType)) and left[field.name].isna().any():
            left[field.name] = left[field.name].astype("Int64")
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    names = sorted(left.columns)
    canonical = lambda df: sorted(tuple(_plain(v) for v in row) for row in df[names].itertuples(index=False))
    a, b = canonical(left), canonical(right)
    if a != b:
        only_left, only_right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"rows {len(a)} / {len(b)}; only here {only_left}; only there {only_right}"
    kinds = {n: (left[n].dtype.kind + str(left[n].dtype.itemsize), right[n].dtype.kind + str(right[n].dtype.itemsize)) for n in names}
    wrong = {n: k for n, k in kinds.items() if k[0] != k[1] and not {"O8"} & set(k)}
    return f"types {wrong}" if wrong and len(a) else None


def _plain(value) -> str:
    if pd.isna(value):
        return "\x00null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark, con = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    prefixes = tuple(sys.argv[2:])
    bad = 0
    for name, build in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                found = difference(build(spark, sf_dir), con, oracles[name])
                state = "ok" if found is None else f"DIFF {found}"
            else:
                state = f"rows {build(spark, sf_dir).count()} (no oracle)"
        except Exception as error:  # the next query may still run
            state = f"ERROR {str(error)[:900]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
