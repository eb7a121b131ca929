"""Comparison of results without regard to row order."""

from __future__ import annotations

import math

import pandas as pd


def cell(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
        return "null"
    if isinstance(v, float):
        return repr(round(v + 0.0, 6))
    if hasattr(v, "year"):
        return str(v)[:10]
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    bad = [(x, y) for x, y in zip(ra, rb, strict=True) if x != y]
    assert not bad, bad[:3]
