"""Compare a Spark result with its DuckDB oracle: same columns, same multiset of rows.

Mirrors what the driver checks (row count, column names, order-insensitive
values). Values are compared exactly after a canonical text form, so float
noise shows up here the same way it would in a value hash.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from pacewise.sources.tables import TABLES, table_path


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, int):
        return v
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), canon(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def _sorted_rows(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, oracle_sql: str, con) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(oracle_sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    res["columns_match"] = sorted(s_cols) == sorted(d_cols)
    if not res["columns_match"]:
        res["spark_only"] = sorted(set(s_cols) - set(d_cols))
        res["oracle_only"] = sorted(set(d_cols) - set(s_cols))
        res["match"] = False
        return res
    a, b = _sorted_rows(s_cols, s_rows), _sorted_rows(d_cols, d_rows)
    res["match"] = a == b
    if not res["match"]:
        cols = sorted(s_cols)
        sa, sb = set(a), set(b)
        only_a = [r for r in a if r not in sb]
        only_b = [r for r in b if r not in sa]
        if only_a and only_b:
            res["first_diff_columns"] = [(c, only_a[0][i], only_b[0][i]) for i, c in enumerate(cols)
                                         if only_a[0][i] != only_b[0][i]][:8]
        res["spark_only_rows"] = len(only_a)
        res["oracle_only_rows"] = len(only_b)
    return res
