"""Order-insensitive comparison of a Spark result with a DuckDB oracle result
(used by tests and by the local correctness run)."""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


def compare(df, con, sql, show=5):
    sc, sr = rows_of_spark(df)
    dc, dr = rows_of_duck(con, sql)
    ok = sc == dc and sr == dr
    msg = f"spark {len(sr)} rows {sc}; duck {len(dr)} rows {dc}"
    if not ok and sc == dc:
        a, b = set(sr), set(dr)
        msg += f"\n only spark: {sorted(a - b, key=repr)[:show]}\n only duck: {sorted(b - a, key=repr)[:show]}"
    return ok, msg
