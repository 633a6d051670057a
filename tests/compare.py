"""Rows of a query and of its SQL, in a form that can be compared."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return str(value) if hasattr(value, "isoformat") else value


def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    return table_rows([d[0] for d in found.description], found.fetchall())


def spark_rows(df):
    return table_rows(df.columns, [tuple(r) for r in df.collect()])
