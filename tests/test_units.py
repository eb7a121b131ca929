"""Hand-made numbers, invariants, and errors that must stop a job."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.util import assert_same
from tidemark.functions import indicators as ind
from tidemark.functions import recursive as rec
from tidemark.functions.expressions import ExpressionError, compile_expression, decode_number, encode_number, rules_to_expression
from tidemark.operators import outcomes as oc
from tidemark.operators import patterns as pt
from tidemark.operators import quality as ql
from tidemark.operators import risk
from tidemark.operators import statistics as st
from tidemark.sources import bars as src


def make_bars(spark, rows):
    """Rows of (open, high, low, close) from one instrument on consecutive days."""
    start = date(2024, 1, 1)
    data = [("A", start + timedelta(i), float(o), float(h), float(low), float(c), 1000.0, i, round(h * 100), round(low * 100), round(c * 100), True, "PASS") for i, (o, h, low, c) in enumerate(rows)]
    return spark.createDataFrame(data, "instrument_id string, trade_date date, open double, high double, low double, close double, volume double, signal_index bigint, hc bigint, lc bigint, cc bigint, eligibility boolean, quality_status string")


def truth(spark, text, values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in names))
    rule = compile_expression(text, names)
    return df.select(rule.selected().alias("s"), rule.available().alias("a")).first()


def test_expression_missing_operand_is_never_selected(spark):
    assert truth(spark, "x > 1", {"x": 2.0})["s"] is True
    assert truth(spark, "x > 1 or y > 0", {"x": 2.0, "y": None})["s"] is False
    got = truth(spark, "x > 5 and y > 0", {"x": 2.0, "y": None})
    assert got["s"] is False and got["a"] is False
    assert truth(spark, "not (x > 5 and y > 0)", {"x": 2.0, "y": None})["s"] is False


def test_expression_chain_stops_early(spark):
    got = truth(spark, "5 < x < y", {"x": 2.0, "y": None})
    assert got["a"] is True and got["s"] is False
    assert truth(spark, "not (5 < x < y)", {"x": 2.0, "y": None})["s"] is True


def test_expression_arithmetic(spark):
    assert truth(spark, "x % 3 == 2", {"x": -7.0})["s"] is True
    assert truth(spark, "x ** 2 == 9 and -x == 3", {"x": -3.0})["s"] is True
    with pytest.raises(Exception, match="(?i)divi"):
        truth(spark, "x / y > 1", {"x": 1.0, "y": 0.0})


@pytest.mark.parametrize("text", ["x", "x + 1", "z > 1", "__import__('os')", "x > True", "x.y > 1", "x > 1 if x else 2", "x >", "x > 1 and x", "x > 1" + " and x > 1" * 60])
def test_expression_refuses(text):
    with pytest.raises(ExpressionError):
        compile_expression(text, ["x"])


def test_names_and_rules():
    assert decode_number(encode_number(-2.5)) == -2.5
    assert rules_to_expression([("a", ">", 1, "and"), ("b", "<", 2, "or"), ("c", ">", 0, "")]) == "((a > 1) and b < 2) or c > 0"


def test_full_frames_only(spark):
    d = make_bars(spark, [(10, 11, 9, 10 + i) for i in range(6)])
    got = [r.s for r in d.withColumn("s", ind.sma(F.col("close"), 3)).orderBy("signal_index").collect()]
    assert got[:2] == [None, None] and got[2:] == [11.0, 12.0, 13.0, 14.0]


def test_future_does_not_change_features(spark):
    d = src.derive_bars(spark, DATA)
    changed = d.withColumn("close", F.when(F.col("trade_date") > "1997-01-01", F.col("close") * 3).otherwise(F.col("close")))
    pick = lambda x: ind.with_market(x).where("trade_date <= '1997-01-01'").select("instrument_id", "trade_date", "return_20", "realized_volatility_20", "sma_50_200_cross_up").toPandas()
    assert_same(pick(d), pick(changed))


def test_recursive_gap_policies():
    x = np.array([1.0, 2, 3, np.nan, 4, 5, 6])
    assert np.isnan(rec.ema(x, 2, "stop")[3:]).all()
    assert rec.ema(x, 2, "reset")[5] == 4.5
    flat = rec.rsi(np.full(20, 5.0), 14)
    assert flat[-1] == 50 and np.isnan(flat[13])
    assert rec.rsi(np.arange(20.0), 14)[-1] == 100 and rec.rsi(-np.arange(20.0), 14)[-1] == 0


def test_outcome_path_by_hand(spark):
    d = make_bars(spark, [(99, 101, 98, 100), (95, 103, 94, 101), (102, 105, 100, 104), (103, 106, 99, 105)])
    event = d.where("signal_index = 0").select("instrument_id", "signal_index", "trade_date")
    r = oc.outcome_paths(event, d, (3, 9)).orderBy("horizon").collect()
    a = r[0]
    assert (a.entry, a.status, a.mfe_offset, a.mae_offset) == (95.0, "COMPLETE", 3, 1)
    assert a.forward_return == pytest.approx(105 / 95 - 1) and a.mfe == pytest.approx(106 / 95 - 1) and a.mae == pytest.approx(94 / 95 - 1)
    assert a.drawdown_upper == pytest.approx(99 / 105 - 1) and a.drawdown_lower == pytest.approx(94 / 103 - 1) and a.drawdown_ambiguous
    assert a.entry_gap == pytest.approx(95 / 100 - 1) and a.gap_down == a.entry_gap and a.gap_up == pytest.approx(102 / 101 - 1)
    assert r[1].status == "TRUNCATED_END_OF_DATA" and r[1].forward_return is None and r[1].partial_return == pytest.approx(105 / 95 - 1)


def test_event_without_next_bar(spark):
    d = make_bars(spark, [(99, 101, 98, 100)])
    r = oc.outcome_paths(d.select("instrument_id", "signal_index", "trade_date"), d, (2,)).first()
    assert r.status == "NO_ENTRY_BAR" and r.entry is None


def test_stop_fills(spark):
    quiet = (100, 101, 99, 100)
    d = make_bars(spark, [quiet, quiet, (100, 101, 94, 97), quiet])
    event = d.where("signal_index = 0").select("instrument_id", "signal_index", "trade_date")
    got = {r.policy_id: r for r in risk.exit_results(event, d, 3, [("s", 0.05, None, None), ("t", None, None, 0.01), ("both", 0.05, None, 0.01), ("hold", None, None, None)]).collect()}
    assert (got["s"].reason, got["s"].exit_price, got["s"].exit_offset) == ("STOP", 95.0, 2)
    assert (got["t"].reason, got["t"].exit_price, got["t"].exit_offset) == ("TARGET", 101.0, 1)
    assert got["both"].exit_offset == 1 and got["hold"].reason == "HORIZON"
    gap = make_bars(spark, [quiet, quiet, (90, 92, 88, 91), quiet])
    r = risk.exit_results(event, gap, 3, [("s", 0.05, None, None)]).first()
    assert (r.reason, r.exit_price) == ("STOP", 90.0)


def test_greedy_stride(spark):
    rows = spark.createDataFrame([("A", i) for i in (0, 3, 5, 9, 10, 11, 20)], "instrument_id string, signal_index bigint")
    assert sorted(r.signal_index for r in oc.stride(rows, 5).collect()) == [0, 5, 10, 20]
    assert sorted(r.signal_index for r in oc.stride(rows, 5, strict=True).collect()) == [0, 9, 20]


def test_lifecycle_prefix_stability(spark):
    d = src.derive_bars(spark, DATA)
    whole = pt.lifecycle_states(d).where("trade_date < '1996-06-01'").toPandas()
    assert_same(whole, pt.lifecycle_states(d.where("trade_date < '1996-06-01'")).toPandas())


def _bar(i, c, h=None, low=None, **more):
    return {"index": i, "date": f"2024-01-{i + 1:02d}", "hc": h or c + 100, "lc": low or c - 100, "cc": c, "ok": True, "trend_ok": True} | more


def test_lifecycle_by_hand():
    t = pt.Tracker(pt.Lifecycle(duration=3, max_range_pct=8, reset_sessions=1, cooldown=2))
    assert [t.step(_bar(i, 10_000))["state"] for i in range(4)] == ["NONE", "NONE", "NONE", "TRIGGER_READY"]
    out = t.step(_bar(4, 10_200))
    assert (out["state"], out["reason"], out["event"]) == ("CONSUMED", "BREAKOUT", True)
    assert t.step(_bar(5, 10_200))["state"] == "NONE"
    with pytest.raises(ValueError, match="order"):
        t.step(_bar(5, 10_000))


def test_lifecycle_gates_and_ends():
    s = pt.Lifecycle(duration=3, max_range_pct=8, reset_sessions=0, volume_ratio=2.0)
    t = pt.Tracker(s)
    for i in range(4):
        t.step(_bar(i, 10_000))
    assert t.step(_bar(4, 10_150, ratio=1.9))["state"] == "QUALIFIED"  # above resistance, too quiet: the base goes on
    assert t.step(_bar(5, 10_150, ratio=2.0))["event"]
    t = pt.Tracker(s)
    for i in range(3):
        t.step(_bar(i, 10_000))
    assert t.step(_bar(3, 9_800))["state"] == "QUALIFIED"  # begins below its support, and ends on the next bar
    assert t.step(_bar(4, 9_800))["reason"] == "closed_below_support"
    t = pt.Tracker(s)
    for i in range(3):
        t.step(_bar(i, 10_000))
    assert t.step(_bar(3, 10_000, action=True))["state"] == "NONE" and t.state["ended_at"] == 3
    assert [t.step(_bar(i, 10_000))["state"] for i in range(4, 8)] == ["NONE"] * 3 + ["TRIGGER_READY"]
    assert t.step(_bar(8, 10_000, ok=False))["reason"] == "data_quality_or_eligibility"


def replayed(rows, s):
    """The same rules looked up over the whole series at every bar, without a running state of the base."""
    out, end, last, held = [], None, None, None
    for i, r in enumerate(rows):
        base, state, reason, event = rows[max(0, i - s.duration) : i], "NONE", "", False
        if held is not None:
            own, high, low = rows[held - s.duration : held], max(x["hc"] for x in rows[held - s.duration : held]), min(x["lc"] for x in rows[held - s.duration : held])
            episode = rows[held - s.duration : i + 1]
            wide = (max(x["hc"] for x in episode) - min(x["lc"] for x in episode)) * 100 > s.max_range_pct * min(x["lc"] for x in episode)
            tests = ((r["action"], "corporate_action_discontinuity"), (not r["ok"], "data_quality_or_eligibility"), (not r["trend_ok"], "trend_context_failed"), (r["cc"] < low, "closed_below_support"), (s.max_age is not None and i - (held - 1) > (s.max_age or 0), "maximum_age_exceeded"), (r["cc"] <= high and wide, "range_expanded_beyond_limit"))
            reason = next((name for hit, name in tests if hit), "")
            if reason:
                state, end, held = "INVALIDATED", i, None
        elif r["action"]:
            end = i
        elif len(base) == s.duration and all(x["ok"] for x in [*base, r]) and r["trend_ok"] and (end is None or (i - end > s.reset_sessions and i - s.duration > end)):
            own, high, low = base, max(x["hc"] for x in base), min(x["lc"] for x in base)
            if (high - low) * 100 <= s.max_range_pct * low:
                held = i
        if held is not None:
            loud = s.volume_ratio is None or (r["ratio"] == r["ratio"] and r["ratio"] >= s.volume_ratio)
            if r["cc"] > high and (last is None or i - last > s.cooldown) and loud:
                state, reason, event, last, end, held = "CONSUMED", "BREAKOUT", True, i, i, None
            else:
                state = "TRIGGER_READY" if 0 <= (high - r["cc"]) / high <= s.trigger_distance else "QUALIFIED"
        out.append((r["signal_index"], state, reason, event))
    return out


@pytest.mark.parametrize("more", [{}, {"volume_ratio": 1.0, "max_age": 30}, {"trend": "ABOVE_SMA_200", "reset_sessions": 12, "cooldown": 30}])
def test_lifecycle_equals_a_replay(spark, more):
    s = pt.Lifecycle(**more)
    bars, actions = src.flawed(src.derive_bars(spark, DATA)), src.corporate_actions(spark, DATA)
    want = set()
    for name, p in pt.tracker_input(bars, s, actions).toPandas().sort_values("signal_index").groupby("instrument_id"):
        want |= {(name, *x) for x in replayed(p.to_dict("records"), s)}
    states = pt.lifecycle_states(bars, s, actions)
    got = {(r.instrument_id, r.signal_index, r.state, r.reason, r.event) for r in states.select("instrument_id", "signal_index", "state", "reason", "event").collect()}
    assert got == want and {x[2] for x in got} >= {"NONE", "QUALIFIED", "INVALIDATED", "CONSUMED"}
    assert pt.lifecycle_events(states).count() == sum(x[4] for x in got)


def test_projection_statuses(spark):
    rows = [("A", "CONSUMED", "BREAKOUT", True, 100, 105, 2.0), ("B", "NONE", "", False, None, 5, None), ("C", "INVALIDATED", "data_quality_or_eligibility", False, 9, 8, 1.0), ("D", "INVALIDATED", "trend_context_failed", False, 9, 8, 1.0), ("E", "INVALIDATED", "maximum_age_exceeded", False, 9, 8, 1.0), ("F", "QUALIFIED", "", False, 100, 101, 1.0), ("G", "TRIGGER_READY", "", False, 100, 99, 1.0), ("H", "QUALIFIED", "", False, 100, 90, 1.0)]
    df = spark.createDataFrame([(*r[:1], date(2024, 1, 2), *r[1:]) for r in rows], "instrument_id string, trade_date date, state string, reason string, event boolean, resistance bigint, cc bigint, ratio double")
    got = {r.instrument_id: r.status for r in pt.projection(df, pt.Lifecycle(volume_ratio=1.5)).collect()}
    assert got == dict(zip("ABCDEFGH", ("BREAKOUT", "INACTIVE", "QUALITY_BLOCKED", "TREND_FILTER_FAIL", "INVALIDATED", "VOLUME_FILTER_FAIL", "TRIGGER_READY", "STRUCTURE_ACTIVE"), strict=True))


def test_verdicts_in_order(spark):
    rows = [(29, 1.0, 0.0, 1.0, 1.0, 1.0), (30, 0.0, 0.0, 1.0, 1.0, 1.0), (30, None, 0.05, 1.0, 1.0, 1.0), (30, 1.0, 0.01, 0.0, 1.0, 1.0), (30, 1.0, 0.01, 1.0, None, 1.0), (30, 1.0, 0.01, 1.0, 0.1, 0.4), (30, None, 0.01, 1.0, 0.1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n int, excess double, p double, beyond double, low double, near double").select("i", st.verdict(*[F.col(c) for c in ("n", "excess", "p", "beyond", "low", "near")]).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [st.VERDICTS[i] for i in (0, 1, 2, 2, 3, 4, 5)]


def test_uuid_ids(spark):
    ids = ["1", "abc", "x" * 70, "ü"]
    df = spark.createDataFrame([(x,) for x in ids], "i string").select("i", ql.instrument_id(F.lit("prov"), F.col("i")).alias("t"))
    for r in df.collect():
        assert r.t == "tsi_" + uuid.uuid5(uuid.NAMESPACE_DNS, f"prov:{r.i}").hex


def test_calendar(spark):
    assert [ql.easter(y) for y in (1997, 2000, 2008, 2024)] == [date(1997, 3, 30), date(2000, 4, 23), date(2008, 3, 23), date(2024, 3, 31)]
    days = {r.trade_date for r in ql.sessions(spark, date(2024, 1, 1), date(2024, 12, 31)).collect()}
    assert len(days) == 252 and date(2024, 6, 19) not in days and date(2024, 3, 29) not in days


def test_split_on_own_date_does_not_adjust(spark):
    d = make_bars(spark, [(400, 400, 400, 400), (100, 100, 100, 100)])
    actions = spark.createDataFrame([("A", date(2024, 1, 2), "split", 4.0)], "instrument_id string, effective_date date, action_type string, ratio double")
    assert [r.split_factor for r in ql.split_factors(d, actions).orderBy("trade_date").collect()] == [0.25, 1.0]


def test_splits_beyond_the_range_of_doubles(spark):
    d = make_bars(spark, [(1, 1, 1, 1)] * 3)
    first = date(2024, 1, 2)
    halves = [("A", first + timedelta(days=i + 1), "split", 2.0) for i in range(1200)]
    back = [("A", first, "split", 0.5 ** 1023), ("A", date(2024, 1, 1), "split", 0.5)]
    actions = spark.createDataFrame(halves + back, "instrument_id string, effective_date date, action_type string, ratio double")
    got = ql.split_factors(d, actions).orderBy("trade_date").collect()
    days = [r.trade_date for r in got]
    bits = [-sum(1 for h in halves if h[1] > x) + 1023 * (first > x) + (date(2024, 1, 1) > x) for x in days]
    assert bits[0] == -177 and min(bits) < -1100
    assert [r.split_log2 for r in got] == pytest.approx(bits)
    assert [r.split_factor for r in got] == pytest.approx([2.0**b for b in bits], rel=1e-9, abs=0)


def test_failures_stop_the_job(spark):
    d = make_bars(spark, [(1, 1, 1, 1), (1, 1, 1, 1)]).withColumn("dataset_version", F.lit("v"))
    with pytest.raises(Exception, match="overlap"):
        ql.compose([d, d], "w").collect()
    with pytest.raises(ValueError, match="window"):
        ql.merge_revision(d, d, "2024-01-02", "w")
    none = spark.createDataFrame([], "instrument_id string, trade_date date, eligible boolean")
    with pytest.raises(Exception, match="membership"):
        src.serve(d, none, "2024-01-01", "2024-12-31").collect()


def test_statistics_do_not_depend_on_partitioning(spark):
    monthly = spark.createDataFrame([(f"2024-{m:02d}", float(m - 6), m) for m in range(1, 13)], "month string, total double, n int")
    a = st.month_bootstrap(monthly.repartition(1), 100, 1).toPandas()
    b = st.month_bootstrap(monthly.repartition(7), 100, 1).toPandas()
    assert_same(a, b)
    assert a.low[0] <= a.high[0]


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r.hypothesis: r.p_adjusted for r in st.adjusted(spark.createDataFrame([(f"h{i}", x) for i, x in enumerate(p)], "hypothesis string, p double"), "benjamini_hochberg").collect()}
    assert got == pytest.approx({"h0": 0.04, "h1": 0.16 / 3, "h2": 0.16 / 3, "h3": 0.5})


def test_walk_forward_needs_three_boundaries():
    with pytest.raises(ValueError):
        st.walk_forward(["a", "b"])
    assert len(st.walk_forward(["a", "b", "c", "d"])) == 2


def test_weekly_blocks_need_a_friday(spark):
    from tidemark.operators.resample import resample

    d = make_bars(spark, [(1, 1, 1, 1)] * 12)  # Monday 2024-01-01 to Friday the 12th, with one weekend
    d = d.where(F.weekday("trade_date") < 5)
    assert resample(d, None).count() == 2
    assert resample(d.where("trade_date < '2024-01-11'"), None).count() == 1



def test_audit_and_folds_reach_the_last_bar(spark):
    from tests.conftest import DATA
    from tidemark.plans import catalogue, research
    from tidemark.sources.bars import derive_bars

    queries = catalogue.queries()
    audit = queries["session_audit_span"](spark, DATA).toPandas()
    assert (audit.expected - audit.missing + audit.unexpected).sum() == derive_bars(spark, DATA).count()
    outcomes = research.breakout_returns(spark, DATA).where("horizon = 20")
    folds = queries["walk_forward_span"](spark, DATA).toPandas().sort_values("fold")
    assert folds.train_n.iloc[0] + folds.test_n.sum() == outcomes.count()
