"""Local re-creation of the oracle check: row count, column names, order-insensitive values."""

from __future__ import annotations

import math
import os
from collections import Counter

from ..sources.tables import TABLES, table_path


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(records: list[dict]) -> Counter:
    return Counter(tuple(_norm(r[k]) for k in sorted(r)) for r in records)


def compare(spark, name: str, sf_dir: str, query_fn, sql_text: str) -> dict:
    sdf = query_fn(spark, sf_dir)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    con = duck_connection(sf_dir)
    cur = con.execute(sql_text)
    cols = [d[0] for d in cur.description]
    d_rows = [dict(zip(cols, r)) for r in cur.fetchall()]
    out = {
        "query": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(sdf.columns) == sorted(cols),
        "spark_columns": sorted(sdf.columns),
        "oracle_columns": sorted(cols),
    }
    if out["columns_match"]:
        a, b = rows_of(s_rows), rows_of(d_rows)
        out["values_match"] = a == b
        if a != b:
            out["only_spark"] = list((a - b).elements())[:3]
            out["only_oracle"] = list((b - a).elements())[:3]
    else:
        out["values_match"] = False
    out["ok"] = out["values_match"] and out["spark_rows"] == out["oracle_rows"]
    return out
