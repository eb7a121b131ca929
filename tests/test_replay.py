"""Replays of scans over many dates against a run for each date."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import patterns as pt
from tidemark.operators import replay as rp
from tidemark.plans.replays import _bars
from tidemark.sources.bars import derive_bars


def test_intervals_are_the_changes(spark):
    states = pt.lifecycle_states(derive_bars(spark, DATA))
    rows = {}
    for r in states.orderBy("instrument_id", "trade_date").collect():
        rows.setdefault(r.instrument_id, []).append((r.trade_date, tuple(r[c] for c in rp.PAYLOAD)))
    want = []
    for i, own in rows.items():
        starts = [(d, x) for n, (d, x) in enumerate(own) if n == 0 or own[n - 1][1] != x]
        want += [(i, d, starts[n + 1][0] if n + 1 < len(starts) else None, x) for n, (d, x) in enumerate(starts)]
    got = [(r.instrument_id, r.from_date, r.to_date, tuple(r[c] for c in rp.PAYLOAD)) for r in rp.change_intervals(states).orderBy("instrument_id", "from_date").collect()]
    assert got == want and len(got) < sum(map(len, rows.values()))


def test_a_replay_equals_a_run_for_each_date(spark):
    """The run sees the bars up to its date alone, so the replay has looked at no later bar either."""
    bars = _bars(spark, DATA).where("instrument_id in ('I0', 'I3', 'I7')").cache()
    dates = [date(1995, 1, 2), date(1996, 3, 4), date(1996, 8, 15), date(1997, 6, 30), date(1998, 12, 1)]
    requests = spark.createDataFrame([(d, i) for d in dates for i in ("I0", "I3", "I7", "gone")], "as_of date, instrument_id string")
    symbols = spark.createDataFrame([("I0", "S0", date(1990, 1, 1), None), ("I7", "S7", date(1990, 1, 1), None), ("I3", "S3", date(1996, 6, 1), date(1997, 12, 31)), ("gone", "G", date(1990, 1, 1), None)], "instrument_id string, symbol string, effective_from date, effective_to date")
    intervals = rp.change_intervals(pt.lifecycle_states(bars))
    whole = {(r.as_of, r.instrument_id): tuple(r) for r in rp.replay(bars, intervals, requests, symbols, "tpch-v1", "u1").collect()}
    assert len(whole) == len(dates) * 4
    for d in dates:
        past = bars.where(F.col("trade_date") <= F.lit(d))
        alone = rp.replay(past, rp.change_intervals(pt.lifecycle_states(past)), requests.where(F.col("as_of") == F.lit(d)), symbols, "tpch-v1", "u1")
        assert {(r.as_of, r.instrument_id): tuple(r) for r in alone.collect()} == {k: v for k, v in whole.items() if k[0] == d}
    assert {v[3] for v in whole.values()} >= {rp.MISSING_HISTORY, rp.MISSING_SESSION, rp.EVALUATED}


def test_statuses_in_order(spark):
    d = [date(2024, 1, n) for n in (2, 3, 4)]
    bars = spark.createDataFrame([("A", d[0], "v1", True, "PASS", 100), ("A", d[1], "v1", False, "PASS", 100), ("B", d[1], "v0", False, "PASS", 100), ("C", d[1], "v1", True, "WARN", 100), ("E", d[1], "v1", True, "PASS", 100), ("F", d[1], "v1", True, "PASS", 100)], "instrument_id string, trade_date date, dataset_version string, eligibility boolean, quality_status string, cc int")
    intervals = spark.createDataFrame([("A", d[0], "QUALIFIED"), ("E", d[1], "TRIGGER_READY"), ("F", d[1], "NONE")], "instrument_id string, from_date date, state string").select("*", F.lit("").alias("reason"), F.lit(False).alias("event"), F.lit(110).alias("resistance"), F.lit(90).alias("support"), F.lit(d[0]).alias("began"))
    symbols = spark.createDataFrame([("E", "X", d[0], None), ("A", "Y", d[0], d[0]), ("F", "Z", d[1], None)], "instrument_id string, symbol string, effective_from date, effective_to date")
    asked = [(day, i) for day in d[1:] for i in "ABCDEF"] + [(d[0], "A")]
    run = lambda rows, universe="u": rp.replay(bars, intervals, spark.createDataFrame(rows, "as_of date, instrument_id string"), symbols, "v1", universe)
    got = {(r.as_of.day, r.instrument_id): (r.status, r.state) for r in run(asked).collect()}
    assert {i: got[3, i] for i in "ABCDEF"} == {"A": (rp.QUALITY, None), "B": (rp.DATASET_MISMATCH, None), "C": (rp.QUALITY, None), "D": (rp.MISSING_HISTORY, None), "E": (rp.EVALUATED, "TRIGGER_READY"), "F": (rp.EVALUATED, None)}
    assert {got[4, i][0] for i in "ACEF"} == {rp.MISSING_SESSION} and got[4, "B"][0] == rp.DATASET_MISMATCH and got[2, "A"] == (rp.EVALUATED, "QUALIFIED")
    bare = rp.replay(bars, intervals, spark.createDataFrame([(d[1], "E")], "as_of date, instrument_id string"), symbols.where("instrument_id = 'A'"), "v1", "u").first()
    assert bare.status == rp.MISSING_SYMBOL
    one, two = (rp.replay_summary(run(asked, u)).orderBy("as_of").collect() for u in ("u", "w"))
    assert [r.requests for r in one] == [1, 6, 6] and all(a.run_id != b.run_id and a.output_checksum != b.output_checksum for a, b in zip(one, two, strict=True))
    assert [r.output_checksum for r in rp.replay_summary(run(asked[::-1]).repartition(5)).orderBy("as_of").collect()] == [r.output_checksum for r in one]
    with pytest.raises(Exception, match="comes twice"):
        run([asked[0], asked[0]]).collect()
    with pytest.raises(ValueError):
        run(asked, " ")
