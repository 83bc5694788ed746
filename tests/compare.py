"""Runs a query in Spark and its SQL twin in DuckDB and compares rows, types and values."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def kind(value):
    return "null" if value is None else "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows]), order


def compare(spark, con, query, text, sf_dir):
    """None when equal, otherwise a description of the first difference."""
    df = query(spark, sf_dir)
    got = df.collect()
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    a_names, a, _ = rows_of(df.columns, got)
    b_names, b, _ = rows_of(names, want)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "no rows"
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return f"row {i}: {x} != {y}"
    return None
