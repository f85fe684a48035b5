"""Run registered queries against their SQL counterparts on DuckDB.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def rows_of(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r))
    return [(n, _kind(table.schema.field(n).type)) for n in names], rows


def differences(con, df, sql: str, limit: int = 3) -> list[str]:
    """What differs between a Spark result and a SQL result; empty if nothing does."""
    schema, got = rows_of(df.toArrow())
    expected_schema, expected = rows_of(con.sql(sql).to_arrow_table())
    found = []
    if schema != expected_schema:
        found.append(f"schema {schema} expected {expected_schema}")
    if len(got) != len(expected):
        found.append(f"rows {len(got)} expected {len(expected)}")
    elif got != expected:
        wrong = [(g, e) for g, e in zip(got, expected) if g != e]
        found.append(f"{len(wrong)} rows differ: {wrong[:limit]}")
    return found


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from caselink.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    sqls = oracle_sql()
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                problems = differences(con, df, sqls[name])
                verdict = "ok" if not problems else "DIFFERS " + "; ".join(problems)[:900]
            else:
                verdict = f"rows {df.count()}"
        except Exception as error:
            verdict = f"FAILED {type(error).__name__}: {str(error)[:900]}"
        print(f"{name:26s} {time.time() - start:7.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
