"""Holds a Spark result against DuckDB's over the same tables: columns by name, rows in any order."""

from __future__ import annotations

import math
import pathlib

import duckdb


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        f = float(value)
        return "nan" if math.isnan(f) else round(f, 5) + 0.0
    return str(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def difference(df, folder: str, sql: str) -> str | None:
    """What differs, or None."""
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    want_columns, want = oracle(folder, sql)
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} against {sorted(want_columns)}"
    a, b = rows(got_columns, got), rows(want_columns, want)
    if a == b:
        return None
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows against {len(b)}; only here {only[0]}; only there {only[1]}"
