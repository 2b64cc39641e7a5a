"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        return v.item() if hasattr(v, "item") else v

    frame = frame[sorted(frame.columns)].astype(object)
    out = [tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, name: str, queries: dict, oracle: dict) -> None:
    df = queries[name](spark, sf_dir)
    got = df.toArrow().to_pandas(types_mapper=None, integer_object_nulls=True)
    want = duck(sf_dir).execute(oracle[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    assert sorted(got.columns) == sorted(want.columns), name
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(rows(got), rows(want), strict=True):
        assert repr(a) == repr(b), (name, a, b)
