"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=str)
