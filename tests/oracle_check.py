"""Compare named queries with their oracle SQL; used by the tests and by hand."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (sorted(columns),
            sorted(tuple(_value(r[i]) for i in order) for r in rows))


def spark_rows(df):
    return normal(df.columns, df.collect())


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def rows(df):
    return sorted(tuple(r) for r in df.collect())
