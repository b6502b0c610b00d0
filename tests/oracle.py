"""The comparison of a query with its SQL: columns by name, rows in any order."""

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(str(plain(r[i])) for i in order) for r in found)


def from_sql(sql: str, sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def from_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
