"""Names of indicators, the frame that they ask for, and strategies over it."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import parameterised as pi
from tidemark.functions.expressions import ExpressionError
from tidemark.plans.named import EXPRESSION, FRAME
from tidemark.sources.bars import derive_bars


@pytest.mark.parametrize("name", FRAME)
def test_names_round_trip(name):
    assert pi.parse_name(name).name == name


@pytest.mark.parametrize(
    "name",
    [
        "pi__rsi__rsi_value__close__p14",
        "pi__rsi__rsi_value__close__14__wilder",
        "pi__rsi__rsi_value__close__p1__wilder",
        "pi__rsi__rsi_value__close__p014__wilder",
        "pi__rsi__rsi_value__close__p14__plain",
        "pi__rsi__roc_pct__close__p14__wilder",
        "pi__rsi__rsi_value__volume__p14__wilder",
        "pi__moving_average__ma_cross_up__close__p20__wma",
        "pi__bollinger_bands__bb_position__close__p20__k99",
        "pi__bollinger_bands__bb_position__close__p20__kx",
        "pi__macd__macd_line_pct__close__p26__f26s12g9",
        "pi__macd__macd_line_pct__close__p26__12_26_9",
        "pi__none__x__close__p20__sma",
    ],
)
def test_other_names_are_refused(name):
    with pytest.raises(ExpressionError):
        pi.parse_name(name)


def test_specs_of_an_expression():
    assert [s.name for s in pi.specs_of(EXPRESSION + " and " + EXPRESSION)] == sorted({n for n in FRAME if n in EXPRESSION})
    with pytest.raises(ExpressionError):
        pi.specs_of("1 +")


def bars(spark, closes, quality="PASS"):
    rows = [("A", d.date(), c, None if c is None else c * 1.02, None if c is None else c * 0.98, c, 100.0 + i, i, quality) for i, (d, c) in enumerate(zip(pd.date_range("2020-01-01", periods=len(closes)), closes, strict=True))]
    return spark.createDataFrame(rows, "instrument_id string, trade_date date, open double, high double, low double, close double, volume double, signal_index int, quality_status string")


def test_gaps_stop_recursive_indicators_and_reset_windows(spark):
    rng = np.random.default_rng(4)
    closes = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 120)))).tolist()
    closes[60] = None
    specs = {n: pi.Spec(*s) for n, s in {"ema": ("moving_average", "ma_distance_pct", 10, "close", "ema"), "sma": ("moving_average", "ma_distance_pct", 10), "rsi": ("rsi", "rsi_value", 5), "atr": ("atr", "atr_pct", 5), "hv": ("historical_volatility", "historical_volatility_pct", 8), "roc": ("price_roc", "roc_pct", 3)}.items()}
    got = pi.with_indicators(bars(spark, closes), specs.values()).orderBy("trade_date").toPandas()
    known = {n: got[s.name].notna().to_numpy() for n, s in specs.items()}
    assert known["ema"][9:60].all() and not known["ema"][60:].any() and not known["ema"][:9].any()
    assert known["rsi"][5:60].all() and not known["rsi"][60:].any() and known["atr"][5:60].all() and not known["atr"][60:].any()
    assert not known["sma"][60:70].any() and known["sma"][70:].all() and not known["roc"][[60, 63]].any() and known["roc"][64:].all()
    assert all(known[n][: s.least_rows - 1].sum() == 0 and known[n][s.least_rows - 1] for n, s in specs.items())
    e = statistics.fmean(closes[:10])
    for c in closes[10:40]:
        e = e + 2 / 11 * (c - e)
    assert math.isclose(got[specs["ema"].name][39], (closes[39] / e - 1) * 100)
    logs = [math.log(b / a) for a, b in zip(closes[20:28], closes[21:29], strict=True)]
    assert math.isclose(got[specs["hv"].name][28], statistics.stdev(logs) * math.sqrt(252) * 100)
    late = [None, *closes[1:]]
    assert pi.with_indicators(bars(spark, late), [specs["ema"], specs["rsi"]]).where(f"`{specs['ema'].name}` is not null or `{specs['rsi'].name}` is not null").count() == 0


def test_one_sort_for_all(spark):
    """Windows of all lengths and the kernels run behind one exchange and one sort of the bars."""
    staged = spark.createDataFrame(bars(spark, [1.0, 2.0] * 30).toPandas())
    plan = pi.with_indicators(staged, map(pi.parse_name, FRAME))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and plan.count("FlatMapGroupsInPandas") == 1


def test_frames_that_are_refused(spark):
    spec = pi.Spec("price_roc", "roc_pct", 3)
    rows = bars(spark, [1.0, 2.0, 3.0, 4.0])
    assert pi.with_indicators(rows, [spec, spec]).columns == [*rows.columns, spec.name] and pi.with_indicators(rows, []) is rows
    with pytest.raises(ExpressionError, match="shadowed"):
        pi.with_indicators(rows.withColumn(spec.name, F.lit(1.0)), [spec])
    with pytest.raises(Exception, match="not PASS"):
        pi.with_indicators(bars(spark, [1.0] * 5, "WARN"), [spec]).collect()


def test_strategies_with_extra_features(spark):
    rows = bars(spark, [1.0, 2.0, 3.0, 4.0])
    extra = lambda *x: spark.createDataFrame([(i, rows.collect()[n].trade_date, f, v) for i, n, f, v in x], "instrument_id string, trade_date date, feature_name string, value double")
    text = "pi__price_roc__roc_pct__close__p2__standard > 10 and mood > 0 and volume > 0"
    got = pi.strategy_frame(rows, text, ["volume"], extra(("A", 2, "mood", 1.0), ("A", 3, "mood", -1.0), ("A", 1, "mood", 1.0)))
    assert [r.signal_index for r in got.where("selected").collect()] == [2]
    with pytest.raises(ExpressionError, match="shadow"):
        pi.strategy_frame(rows, text, ["volume"], extra(("A", 2, "mood", 1.0), ("A", 2, "close", 1.0)))
    with pytest.raises(ExpressionError, match="unknown names"):
        pi.strategy_frame(rows, text, [], extra(("A", 2, "mood", 1.0)))
    with pytest.raises(Exception, match="comes twice"):
        pi.strategy_frame(rows, text, ["volume"], extra(("A", 2, "mood", 1.0), ("A", 2, "mood", 1.0))).collect()
    with pytest.raises(Exception, match="unknown instrument"):
        pi.strategy_frame(rows, text, ["volume"], extra(("B", 2, "mood", 1.0))).write.format("noop").mode("overwrite").save()


def test_the_future_does_not_change_values(spark):
    b = derive_bars(spark, DATA).where("instrument_id = 'I1'")
    specs = [pi.parse_name(n) for n in FRAME]
    whole = pi.with_indicators(b, specs).where("signal_index < 300").orderBy("trade_date").toPandas()
    part = pi.with_indicators(b.where("signal_index < 300"), specs).orderBy("trade_date").toPandas()
    pd.testing.assert_frame_equal(whole, part)
