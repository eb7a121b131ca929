"""Queries of indicators and strategies by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parameterised as pi
from tidemark.plans import features as ft
from tidemark.plans.features import q_full, q_lag, recursive_sql
from tidemark.sources.bars import derive_bars

#: Indicators of all families, over several sources, lengths and widths, with their SQL over ``named``.
_BAND = lambda k: f"(m20 {k:+g}::DOUBLE * d20)"


def _q_cross(up: bool, a: str, b: str) -> str:
    x, y = (a, b) if up else (b, a)
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND {x}_1 IS NOT NULL AND {y}_1 IS NOT NULL THEN CAST({x} > {y} AND {x}_1 <= {y}_1 AS DOUBLE) END"


FRAME = {
    "pi__moving_average__ma_distance_pct__high__p20__sma": "(high / m20h - 1) * 100",
    "pi__moving_average__ma_cross_up__close__p20__sma": _q_cross(True, "close", "m20"),
    "pi__moving_average__ma_cross_down__close__p20__sma": _q_cross(False, "close", "m20"),
    "pi__moving_average__ma_distance_pct__close__p12__ema": "(close / e12 - 1) * 100",
    "pi__moving_average__ma_cross_up__close__p26__ema": _q_cross(True, "close", "e26"),
    "pi__moving_average__ma_cross_down__close__p26__ema": _q_cross(False, "close", "e26"),
    "pi__bollinger_bands__bb_upper_distance_pct__close__p20__k2p5": f"(close / {_BAND(2.5)} - 1) * 100",
    "pi__bollinger_bands__bb_lower_reached__close__p20__k1": f"CAST(low <= {_BAND(-1)} AS DOUBLE)",
    "pi__bollinger_bands__bb_bandwidth_pct__close__p20__k2": f"({_BAND(2)} - {_BAND(-2)}) / m20 * 100",
    "pi__bollinger_bands__bb_middle_cross_down__close__p20__k2": _q_cross(False, "close", "m20"),
    "pi__price_roc__roc_pct__open__p15__standard": "(open / o15 - 1) * 100",
    "pi__rsi__rsi_value__close__p14__wilder": "rsi_14",
    "pi__macd__macd_histogram_pct__close__p26__f12s26g9": "macd_histogram_pct",
    "pi__macd__macd_cross_up__close__p26__f12s26g9": "macd_bullish_cross",
    "pi__atr__atr_pct__close__p14__wilder": "atr_wilder_pct_14",
    "pi__relative_volume__rvol__close__p10__prior": "volume / v10",
    "pi__average_dollar_volume__average_dollar_volume__close__p30__prior": "a30",
    "pi__historical_volatility__historical_volatility_pct__close__p30__annual252": "h30 * sqrt(252) * 100",
    "pi__prior_high__prior_high_distance_pct__close__p40__prior": "(close / t40 - 1) * 100",
    "pi__prior_high__prior_high_breakout__close__p40__prior": "CAST(close > t40 AS DOUBLE)",
}

_NAMED = (
    f"""lined AS MATERIALIZED (SELECT *, {q_full("avg", "close", 20)} AS m20, {q_full("stddev_pop", "close", 20)} AS d20, {q_full("avg", "high", 20)} AS m20h, {q_lag("open", 15)} AS o15, {q_full("avg", "volume", 10, -1)} AS v10,
  {q_full("avg", "(close * volume)", 30, -1)} AS a30, {q_full("stddev_samp", "lr", 30)} AS h30, {q_full("max", "high", 40, -1)} AS t40
  FROM (SELECT *, ln(close / {q_lag("close")}) AS lr FROM bars))""",
    ft._q_ema(12, "x12"),
    ft._q_ema(26, "x26"),
    f"""named AS MATERIALIZED (SELECT *, {q_lag("close")} AS close_1, {q_lag("m20")} AS m20_1, {q_lag("e26")} AS e26_1 FROM (
  SELECT l.*, a.e AS e12, b.e AS e26, rsi_14, macd_histogram_pct, macd_bullish_cross, atr_wilder_pct_14 FROM lined l LEFT JOIN x12 a ON a.instrument_id = l.instrument_id AND a.i = l.signal_index LEFT JOIN x26 b ON b.instrument_id = l.instrument_id AND b.i = l.signal_index
  JOIN ({ft.RSI_SQL}) r ON r.instrument_id = l.instrument_id AND r.trade_date = l.trade_date JOIN ({ft.MACD_SQL}) m ON m.instrument_id = l.instrument_id AND m.trade_date = l.trade_date
  JOIN ({ft.ATR_WILDER_SQL}) w ON w.instrument_id = l.instrument_id AND w.trade_date = l.trade_date))""",
)


def pi_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.rounded(pi.with_indicators(derive_bars(spark, sf_dir), map(pi.parse_name, FRAME)), FRAME, 6)


FRAME_SQL = recursive_sql("SELECT instrument_id, trade_date, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in FRAME.items()) + " FROM named", *_NAMED)

EXPRESSION = (
    "pi__rsi__rsi_value__close__p14__wilder < 55 and pi__moving_average__ma_distance_pct__close__p12__ema > -1 and 0.5 < pi__relative_volume__rvol__close__p10__prior < 3 and month <= 6"
)


def strategy_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that an expression over named indicators and an extra feature selects."""
    bars = derive_bars(spark, sf_dir)
    extra = bars.select("instrument_id", "trade_date", F.lit("month").alias("feature_name"), F.month("trade_date").cast("double").alias("value"))
    return pi.strategy_frame(bars, EXPRESSION, extra=extra).where("selected").select("instrument_id", "trade_date", "signal_index")


STRATEGY_SQL = recursive_sql(
    "SELECT instrument_id, trade_date, signal_index FROM named WHERE rsi_14 < 55 AND (close / e12 - 1) * 100 > -1 AND volume / v10 > 0.5 AND volume / v10 < 3 AND month(trade_date) <= 6",
    *_NAMED,
)

QUERIES = {"pi_frame": (pi_frame, FRAME_SQL), "strategy_by_names": (strategy_by_names, STRATEGY_SQL)}
