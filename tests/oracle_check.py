"""Compare every registered query with its SQL on one data folder: values, names, types."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def sort_key(row: tuple):
    return [(v is None, "" if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v))) for v in row]


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=sort_key)


def differences(df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    theirs, ours = relation.columns, df.columns
    if sorted(theirs) != sorted(ours):
        return [f"columns {sorted(set(theirs) ^ set(ours))}"]
    found = []
    oracle_types = dict(zip(theirs, (str(t) for t in relation.types)))
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind) != oracle_types[name]:
            found.append(f"type of {name}: {kind} / {oracle_types[name]}")
    expected = rows_of(theirs, relation.fetchall())
    actual = rows_of(ours, [tuple(r) for r in df.collect()])
    if len(expected) != len(actual):
        return [*found, f"{len(actual)} rows, expected {len(expected)}"]
    names = sorted(ours)
    for a, b in zip(actual, expected):
        for name, x, y in zip(names, a, b):
            if x != y:
                close = isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12)
                found.append(f"{name}: {x!r} / {y!r}{' (last place)' if close else ''}")
    return found


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from forecast_duel.session import local_session

    spark, con = local_session(), connect(folder)
    sqls, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            found = differences(query(spark, folder), con, sqls[name])
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok'} {name} {time.time() - start:.2f}s", *found[:4], sep="\n   ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
