"""Runs registered queries and their SQL side by side; usable as a script:

    python -m tests.compare FOLDER [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

import duckdb

import __spark_entry__ as entry


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v) for v in row)


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def spark_table(df) -> tuple[list[str], list[tuple]]:
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    return table([d[0] for d in result.description], result.fetchall())


def difference(mine, theirs) -> str:
    """Empty if equal. Values and their Python types must agree."""
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows != {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(mine[0], a))} != {dict(zip(mine[0], b))}"
    if any(isinstance(v, float) and not math.isfinite(v) for r in mine[1] for v in r):
        return "a value is not finite"
    return ""


def main(folder: str, names: list[str]) -> None:
    from flowlab.session import get_session

    spark = get_session(**{
        "spark.master": "local[8]", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            mine = spark_table(query(spark, folder))
            verdict = difference(mine, sql_table(con, sql[name])) if name in sql else "(no SQL)"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.perf_counter() - start
        ok = verdict in ("", "(no SQL)")
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {took:6.2f}s {verdict}", flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
