"""Paths of the trend baseline against plain loops."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_timeframes import daily
from tidemark.operators import contexts as cx
from tidemark.operators import experiments as ex


def test_path_measures_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    closes = (100 * np.exp(np.cumsum(rng.normal(0, 0.03, 60)))).round(2).tolist()
    odd = {17: (True, "QUARANTINE"), 40: (False, "PASS")}
    bars = daily(spark, ("A", "2024-01-01", closes, odd), ("B", "2024-01-01", closes[:3], {}))
    events = bars.select("instrument_id", "signal_index").where("signal_index % 2 = 0")
    horizons = (1, 5, 12)
    rows = {(r.instrument_id, r.signal_index): r for r in bars.collect()}
    want = {}
    for (i, at) in rows:
        for h in horizons:
            path = [rows.get((i, at + k)) for k in range(1, h + 1)]
            if at % 2 or any(p is None or not p.eligibility or p.quality_status != "PASS" for p in path):
                continue
            entry, peak, worst = path[0].open, path[0].open, 0.0
            for p in path:
                peak = max(peak, p.high)
                worst = min(worst, p.low / peak - 1)
            want[i, at, h] = (path[-1].close / entry - 1, max(p.high for p in path) / entry - 1, min(p.low for p in path) / entry - 1, worst)
    got = {(r.instrument_id, r.signal_index, r.horizon): (r.forward_return, r.mfe, r.mae, r.max_drawdown) for r in ex.path_measures(bars, events.unionByName(events), horizons).collect()}
    assert got.keys() == want.keys() and len(want) > 40
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    assert ex.path_measures(bars, events.where("false"), horizons).count() == 0


def test_contexts_are_thinned_by_themselves(spark):
    bars = daily(spark, ("A", "2024-01-01", [100.0 + i for i in range(30)], {4: (True, "WARN")}))
    flags = bars.select("instrument_id", "trade_date", *[(F.lit(True) if c == "t0" else (F.col("signal_index") >= 4) if c == "t1" else F.lit(False)).alias(c) for c in ex.CONTEXTS])
    got = {(r.context, r.horizon): r for r in ex.trend_baseline(bars, flags, (2,), 5).collect()}
    # every bar, the unusable one passed over: 0, 5, 10, 15, 20, 25; from the fourth bar on: 5, 10, ...
    assert got["t0", 2].signals == 30 and got["t0", 2].sample_size == 6 and got["t1", 2].signals == 26 and got["t1", 2].sample_size == 5
    assert got["t6", 2].signals == got["t6", 2].sample_size == 0 and got["t6", 2].mean_return is None


def test_contexts_are_fixed_before_their_signal(spark):
    bars = daily(spark, ("A", "2024-01-01", [10.0, 12.0, 11.0, 13.0, 14.0], {}))
    events = bars.where("signal_index in (1, 3)").select(F.concat(F.lit("e"), F.col("signal_index").cast("string")).alias("event_id"), "instrument_id", "signal_index", "trade_date", "dataset_version")
    context = lambda *rows: spark.createDataFrame([(e, v, date(2023, 12, 1), end, 1.0, 2.0) for e, v, end in rows], "event_id string, dataset_version string, formation_start date, formation_end date, support double, resistance double")
    sent = context(("e1", "v1", date(2024, 1, 1)), ("other", "v9", date(2030, 1, 1)))
    got = {r.event_id: r for r in cx.with_context(events, sent, bars, 3).collect()}
    assert got["e1"].context == "SUPPLIED" and (got["e1"].support, got["e1"].resistance) == (1.0, 2.0)
    assert got["e3"].context == "FORMATION" and (got["e3"].support, got["e3"].resistance, str(got["e3"].formation_start), str(got["e3"].formation_end)) == (9.0, 13.0, "2024-01-01", "2024-01-03")
    assert {r.event_id: r.context for r in cx.with_context(events, sent).collect()} == {"e1": "SUPPLIED", "e3": "NONE"}
    for bad, what in ((context(("e1", "v1", date(2024, 1, 2))), "not fixed before"), (context(("e1", "v2", date(2024, 1, 1))), "another dataset"), (context(("e1", "v1", date(2024, 1, 1)), ("e1", "v1", date(2024, 1, 1))), "several contexts")):
        with pytest.raises(Exception, match=what):
            cx.with_context(events, bad, bars, 3).collect()
    with pytest.raises(Exception, match="incomplete formation"):
        cx.with_context(events, context(), bars, 3).collect()
