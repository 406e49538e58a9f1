"""Run a registered query and its SQL and compare them as bags of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


_FAMILY = {"INTEGER": "whole", "BIGINT": "whole", "SMALLINT": "whole", "DOUBLE": "float", "VARCHAR": "text",
           "TIMESTAMP": "moment", "DATE": "date", "BOOLEAN": "truth",
           "int": "whole", "bigint": "whole", "smallint": "whole", "double": "float", "string": "text",
           "timestamp_ntz": "moment", "date": "date", "boolean": "truth"}


def differences(frame, connection, sql) -> list[str]:
    """What differs between a DataFrame and a SQL result; empty when equal."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _FAMILY.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected = _bag(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    found = {n: _FAMILY.get(t, t) for n, t in frame.dtypes}
    problems = [f"type of {n}: {found[n]} != {kinds[n]}" for n in names if found[n] != kinds[n]]
    actual = _bag(frame.columns, [tuple(r) for r in frame.collect()])
    if sum(expected.values()) != sum(actual.values()):
        problems.append(f"rows {sum(actual.values())} != {sum(expected.values())}")
    extra, lacking = list((actual - expected).items()), list((expected - actual).items())
    if extra or lacking:
        problems.append(f"{len(extra)} only in Spark e.g. {extra[:2]}; {len(lacking)} only in SQL e.g. {lacking[:2]}")
    return problems
