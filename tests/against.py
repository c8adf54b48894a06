"""Comparing a DataFrame with SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa


def _plain(kind: pa.DataType) -> str:
    return str(kind).replace("large_", "").replace("element", "item").replace("l: ", "item: ").replace(" not null", "")


def rows_and_types(table: pa.Table):
    names = sorted(table.column_names)
    rows = sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names)))) if names else []
    return names, [_plain(table.schema.field(n).type) for n in names], rows


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if names, types and rows are equal."""
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    theirs = db.execute(sql).to_arrow_table()
    ours = df.toArrow()
    a, b = rows_and_types(ours), rows_and_types(theirs)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"types {a[1]} and {b[1]}"
    if a[2] != b[2]:
        left, right = set(a[2]), set(b[2])
        return f"{len(a[2])} and {len(b[2])} rows; only ours {sorted(left - right)[:3]}; only SQL's {sorted(right - left)[:3]}"
    return ""
