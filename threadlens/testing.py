"""Helpers to compare a Spark result with a DuckDB result (order-insensitive)."""

from __future__ import annotations

import hashlib
import math

from threadlens.sources.tables import GIVEN_TABLES


def duckdb_views(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in GIVEN_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)  # strict: no rounding beyond what the queries do
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def digest(rows: list[tuple]) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update("\x1f".join(r).encode())
        h.update(b"\x1e")
    return h.hexdigest()


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    sc, sr = canonical(s_cols, s_rows)
    dc, dr = canonical(d_cols, d_rows)
    res = {"rows_spark": len(sr), "rows_oracle": len(dr), "columns_match": sc == dc,
           "values_match": sc == dc and digest(sr) == digest(dr)}
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sc, dc
    elif not res["values_match"]:
        only_s = sorted(set(sr) - set(dr))[:2]
        only_d = sorted(set(dr) - set(sr))[:2]
        res["example_spark_only"], res["example_oracle_only"] = only_s, only_d
    return res
