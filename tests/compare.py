"""Spark result against DuckDB result as sorted rows over the same columns."""

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def duck_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return columns, result.fetchall()


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = [tuple(round(v, 4) if isinstance(v, float) else v for v in (row[i] for i in order)) for row in rows]
    return sorted(fixed, key=repr)


def differences(df, sql: str, folder: str) -> str | None:
    columns, expected = duck_rows(sql, folder)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(columns, expected)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None
