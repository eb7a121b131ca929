"""Queries with crosses of a close and its mean of 20, on tables where a close equals that mean.

There the last bit of the mean, so the order in which doubles are added, decides a cross, and the SQL's rows may
differ (open findings F2 and F3 of round 3). These tests do not settle that: they ask that nothing else differs.
"""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tests.util import assert_same, cell
from tidemark.plans import catalogue
from tidemark.sources.bars import with_bars

KEYS = ["instrument_id", "trade_date"]
CROSSES = {
    "pi_bollinger": ["bb_middle_cross_up", "bb_middle_cross_down"],
    "pi_frame": ["pi__moving_average__ma_cross_up__close__p20__sma", "pi__moving_average__ma_cross_down__close__p20__sma", "pi__bollinger_bands__bb_middle_cross_down__close__p20__k2"],
}
TIED = with_bars(
    """SELECT instrument_id, trade_date, coalesce(tied OR lag(tied) OVER w, FALSE) AS near_tie
FROM (SELECT *, 20 * cc = sum(cc) OVER (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AND signal_index >= 19 AS tied FROM bars)
WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)"""
)


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    """Six copies of the smallest items with shifted suppliers; in DuckDB 2.0.0 two rows of the SQL differ here."""
    folder = tmp_path_factory.mktemp("ties")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_suppkey + 1005 * i AS l_suppkey) FROM '{DATA}/lineitem.parquet', range(6) AS r(i)) TO '{folder}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), lambda sql: con.sql(sql).df()


def by_keys(df: pd.DataFrame) -> pd.DataFrame:
    return df.assign(trade_date=pd.to_datetime(df["trade_date"])).sort_values(KEYS).reset_index(drop=True)


@pytest.mark.parametrize("name", CROSSES)
def test_only_ties_differ(spark, copy, name):
    folder, sql = copy
    got, want, tied = (by_keys(df) for df in (catalogue.queries()[name](spark, folder).toPandas(), sql(catalogue.oracle_sql()[name]), sql(TIED)))
    assert tied["near_tie"].any()
    assert_same(got.drop(columns=CROSSES[name]), want.drop(columns=CROSSES[name]))
    for c in CROSSES[name]:
        other = got[c].map(cell) != want[c].map(cell)
        assert not (other & ~tied["near_tie"]).any(), got[other & ~tied["near_tie"]].head(3)
