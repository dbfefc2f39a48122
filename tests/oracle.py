"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{Path(sf_dir) / t}.parquet'")
        return db.execute(sql).df()


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    """Column names and rows in an order of their own."""
    names = sorted(df.columns)
    return names, sorted((tuple(map(_plain, r)) for r in df[names].itertuples(index=False, name=None)), key=repr)
