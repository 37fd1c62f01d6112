"""Compare registered queries with their SQL: ``python -m tests.compare [folder] [names…]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from __spark_entry__ import oracle_sql, queries
from noteweave.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        if Path(f"{folder}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def normalized(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, folder: str, name: str) -> str | None:
    """None when query and SQL agree, else a short description."""
    table = queries()[name](spark, folder)
    mine = normalized(table.columns, [tuple(r) for r in table.collect()])
    columns, rows = oracle_rows(folder, oracle_sql()[name])
    theirs = normalized(columns, rows)
    if sorted(columns) != sorted(table.columns):
        return f"columns {sorted(table.columns)} vs {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            cells = [(c, x, y) for c, x, y in zip(sorted(columns), a, b) if x != y]
            return "first difference " + repr(cells)[:1500]
    return None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    for name in chosen:
        start = time.time()
        try:
            found = difference(spark, folder, name) or "ok"
        except Exception as error:  # noqa: BLE001 - report and go on
            found = "error " + str(error)[:1200]
        print(f"RESULT {name} {time.time() - start:.1f}s {found}", flush=True)


if __name__ == "__main__":
    main()
