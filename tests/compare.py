"""Run the SQL counterpart of a query in DuckDB and compare whole results."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(plain(row[i]) for i in order) for row in rows]
    return names, sorted(values, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    found = con.execute(sql)
    return normal([c[0] for c in found.description], found.fetchall())


SAME_KIND = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"},
}


def type_differences(con, sql, df):
    declared = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(c, t, declared.get(c)) for c, t in df.dtypes if declared.get(c) not in SAME_KIND.get(t, set())]
