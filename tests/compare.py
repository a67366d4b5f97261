"""Runs an oracle in DuckDB and compares its rows with a Spark result."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


FAMILIES = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int",
    "bigint": "bigint", "hugeint": "hugeint", "double": "double", "varchar": "string",
    "string": "string", "boolean": "boolean",
}


def oracle(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: FAMILIES.get(str(d[1]).lower(), str(d[1]).lower()) for d in result.description}
    return types, rows_of(columns, result.fetchall())


def spark_result(df):
    types = {f.name: FAMILIES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    return types, rows_of(df.columns, [tuple(r) for r in df.collect()])
