"""Compare queries with their SQL: ``python tests/oracle.py FOLDER [NAME ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dateline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _value(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_value(v) for v in value)
    return value


def normal(names: list[str], rows: list) -> tuple[list[str], Counter]:
    """Columns by name, rows without order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and SQL, empty when nothing does."""
    result = connection.execute(sql)
    types = {c[0]: str(c[1]) for c in result.description}
    want_names, want = normal([c[0] for c in result.description], result.fetchall())
    got_names, got = normal(frame.columns, frame.collect())
    found = []
    if got_names != want_names:
        return [f"columns {got_names} for {want_names}"]
    spelled = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    for name, kind in frame.dtypes:
        if kind in spelled and spelled[kind] != types[name]:
            found.append(f"type of {name}: {kind} for {types[name]}")
    if sum(got.values()) != sum(want.values()):
        found.append(f"{sum(got.values())} rows for {sum(want.values())}")
    if got != want:
        found += [f"extra   {str(r)[:300]}" for r in list((got - want).elements())[:3]]
        found += [f"missing {str(r)[:300]}" for r in list((want - got).elements())[:3]]
    return found


def main() -> None:
    import __spark_entry__ as project

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(**{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql = project.oracle_sql()
    bad = 0
    for name, query in project.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            if name in sql:
                found = differences(frame, connection, sql[name])
            else:
                found = [] if frame.count() >= 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok' if name in sql else 'rows'} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("    ", line)
    print(f"{bad} failed")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
