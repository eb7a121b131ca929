"""Data that arrives in parts: restarts, repeated batches and refusals."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.util import assert_same
from tidemark.functions import recursive as rec
from tidemark.operators import incremental as inc
from tidemark.sources import revisions as rv
from tidemark.sources.bars import canonical, derive_bars


def series(n: int, seed: int = 2, gaps: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    p = pd.DataFrame({"trade_date": pd.date_range("2020-01-01", periods=n).date, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1, 100, n).astype(float)})
    if gaps:
        p.loc[rng.random(n) < 0.05, "close"] = np.nan
    return p


@pytest.mark.parametrize("gaps", [False, True])
def test_steps_of_any_size_equal_one_step(gaps):
    p = series(500, gaps=gaps)
    whole, _ = inc.stepped(None, p)
    for cuts in ([1, 2, 3, 250, 251, 499], [13, 14, 15, 34, 200], list(range(1, 500))):
        state, out = None, []
        for a, b in zip([0, *cuts], [*cuts, 500], strict=True):
            got, state = inc.stepped(state, p.iloc[a:b])
            out.append(got)
        got = pd.concat(out, ignore_index=True)
        pd.testing.assert_frame_equal(got, whole, check_exact=False, rtol=1e-10)
        assert state["n_rows"] == 500 and len(state["tail"]) == inc.TAIL


def test_smoothing_stops_at_a_gap_for_good():
    x = np.array([1.0, 2, 3, np.nan, 5, 6, 7])
    whole, _ = rec.smoothed(x, 2, 0.5, "stop")
    for cut in range(8):
        a, state = rec.smoothed(x[:cut], 2, 0.5, "stop")
        b, _ = rec.smoothed(x[cut:], 2, 0.5, "stop", state)
        np.testing.assert_array_equal(np.concatenate((a, b)), whole)
    assert np.isnan(whole[3:]).all() and whole[1] == 1.5


def test_earlier_and_repeated_bars_are_refused():
    p = series(30)
    _, state = inc.stepped(None, p.iloc[:20])
    for bad in (p.iloc[19:25], p.iloc[5:6], pd.concat([p.iloc[20:22], p.iloc[21:22]])):
        with pytest.raises(inc.NotLater):
            inc.stepped(state, bad)
    out, same = inc.stepped(state, p.iloc[:0])
    assert not len(out) and same["last_date"] == state["last_date"] and same["smoothings"] == state["smoothings"]


def test_feature_log_restarts(spark, tmp_path):
    bars = derive_bars(spark, DATA).where("instrument_id in ('I0', 'I1', 'I2')")
    late = bars.where("instrument_id <> 'I2' or trade_date < '1997-01-01'")  # one instrument has no new bars later on
    first, second, third = list(inc.parts(late, ["1996-01-01", "1998-01-01"]))
    log = inc.FeatureLog(spark, str(tmp_path / "a"))
    assert log.append(first, 0) and not log.append(first, 0)
    # a failure halfway leaves nothing behind
    with pytest.raises(Exception, match="not later"):
        log.append(first, 1)
    assert log.batches() == [0]
    again = inc.FeatureLog(spark, str(tmp_path / "a"))
    assert again.append(second, 1) and again.append(third, 2) and not again.append(second, 1)
    with pytest.raises(inc.NotLater):
        log.append(third, -1)
    once = inc.FeatureLog(spark, str(tmp_path / "b"))
    once.append(late, 0)
    rounded = lambda x: x.features().select("instrument_id", "trade_date", "signal_index", *[F.round(f, 8).alias(f) for f in inc.FEATURES]).toPandas()
    assert_same(rounded(again), rounded(once))
    assert {r.instrument_id: r.n_rows for r in again.state().collect()} == {r.instrument_id: r.n_rows for r in once.state().collect()}
    assert all(len(r.tail) <= inc.TAIL for r in again.state().collect())


def bar(i: str, day: str, close: float | None, provider: str = "p", version: str = "v1"):
    d = date.fromisoformat(day)
    return (i, d, 1.0, 2.0, 0.5, close, 10.0, 1.0, 0.0, 1.0, 2.0, 0.5, close, provider, version, "PASS")


def table_of(spark, rows):
    from tidemark.sources.bars import BAR_SCHEMA

    return spark.createDataFrame(rows, BAR_SCHEMA)


@pytest.fixture
def revised(spark, tmp_path):
    table = rv.RevisionTable(spark, str(tmp_path / "table"))
    table.create(table_of(spark, [bar("a", "2024-01-02", 1.0), bar("a", "2024-02-01", 2.0), bar("b", "2024-02-01", None)]))
    return table


def closes(df):
    return sorted(((r.instrument_id, str(r.trade_date), r.close_raw) for r in df.collect()), key=str)


def test_revision_adds_replaces_and_keeps_parents(spark, revised):
    incoming = table_of(spark, [bar("a", "2024-02-01", 2.5, version="v2"), bar("b", "2024-02-01", None, version="v2"), bar("c", "2024-03-01", 3.0, version="v2")])
    got = revised.revise(incoming, "v2", "2024-02-01", batch=7)
    assert got["counts"] == {"ADDED": 1, "REVISED": 1, "UNCHANGED": 1, "CARRIED": 2, "MONTHS": 2} and got["rows"] == 4 and got["parent"] == "v1"
    assert closes(revised.read()) == [("a", "2024-01-02", 1.0), ("a", "2024-02-01", 2.5), ("b", "2024-02-01", None), ("c", "2024-03-01", 3.0)]
    assert {r.dataset_version for r in revised.read().collect()} == {"v2"}
    assert closes(revised.read(0)) == [("a", "2024-01-02", 1.0), ("a", "2024-02-01", 2.0), ("b", "2024-02-01", None)]
    months = [m["months"] for m in revised.history()]
    assert months[0]["2024-01"] == months[1]["2024-01"] and months[0]["2024-02"] != months[1]["2024-02"]


def test_a_batch_is_applied_once_and_nothing_new_writes_nothing(spark, revised):
    incoming = table_of(spark, [bar("a", "2024-02-01", 2.5, version="v2")])
    first = revised.revise(incoming, "v2", "2024-01-01", batch=1)
    assert revised.revise(incoming, "v2", "2024-01-01", batch=1) == first and len(revised.history()) == 2
    same = revised.revise(table_of(spark, [bar("a", "2024-02-01", 2.5, version="v3")]), "v3", "2024-01-01", batch=2)
    assert same["version"] == "v2" and same["months"] == first["months"] and same["counts"]["UNCHANGED"] == 1
    none = revised.revise(table_of(spark, []), "v4", "2024-01-01", batch=3)
    assert none["counts"] == {"ADDED": 0, "REVISED": 0, "UNCHANGED": 0, "CARRIED": 3, "MONTHS": 0}


@pytest.mark.parametrize(
    "rows, version, start",
    [
        ([bar("a", "2024-01-02", 9.0, version="v2")], "v2", "2024-02-01"),
        ([bar("a", "2024-02-01", 9.0, provider="q", version="v2")], "v2", "2024-01-01"),
        ([bar("a", "2024-02-01", 9.0, version="v3")], "v2", "2024-01-01"),
        ([bar("a", "2024-02-01", 9.0, version="v2"), bar("b", "2024-02-01", 9.0, provider="q", version="v2")], "v2", "2024-01-01"),
        ([bar("a", "2024-02-01", 9.0, version="v2"), bar("a", "2024-02-01", 8.0, version="v2")], "v2", "2024-01-01"),
        ([bar("a", "2024-02-01", 9.0, version="v1")], "v1", "2024-01-01"),
    ],
    ids=["early", "provider", "version", "providers", "repeated", "no new version"],
)
def test_revisions_outside_of_policy_fail(spark, revised, rows, version, start):
    with pytest.raises(rv.RevisionConflict):
        revised.revise(table_of(spark, rows), version, start)
    assert len(revised.history()) == 1


def test_every_field_counts_as_content(spark, revised):
    whole = {f: n for n, f in enumerate(("instrument_id", "trade_date", *[c for c in canonical(derive_bars(spark, DATA)).columns if c not in rv.KEY]))}
    for n, field in enumerate(rv.CONTENT):
        row = list(bar("a", "2024-02-01", 2.0))
        if field == "provider_id":
            continue
        row[whole[field]] = "WARN" if field == "quality_status" else None
        found = rv.classified(table_of(spark, [bar("a", "2024-02-01", 2.0)]), table_of(spark, [tuple(row)])).collect()
        assert [r.change for r in found] == ["REVISED"], (n, field)


def test_an_early_correction_stops_the_stream(spark, revised, tmp_path):
    path = str(tmp_path / "in")
    table_of(spark, [bar("a", "2024-01-02", 9.0)]).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    with pytest.raises(Exception, match="a correction of 2024-01-02 before"):
        rv.revise_from_stream(revised, stream, "2024-02-01", str(tmp_path / "checkpoint"))
    assert len(revised.history()) == 1
