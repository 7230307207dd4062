"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(plain(row[n]) for n in order) for row in rows)


def compare(spark, con, folder, name, run, oracle) -> tuple[bool, str]:
    began = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if oracle is None:
        return True, f"{sum(got.values())} rows, no SQL, {took:.1f}s"
    began = time.time()
    cursor = con.execute(oracle)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra, missing = got - want, want - got
        return False, (
            f"{sum(got.values())} vs {sum(want.values())} rows; columns {sorted(columns)}\n"
            f"   only in Spark {list(extra)[:3]}\n   only in SQL   {list(missing)[:3]}"
        )
    return True, f"{sum(got.values())} rows, {took:.1f}s (SQL {time.time() - began:.1f}s)"


def main(sf: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from seriatim.session import session

    spark = session("check")
    folder = f"/root/testdata/sf{sf}"
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note = compare(spark, con, folder, name, run, oracle.get(name))
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print("bad:", bad)
