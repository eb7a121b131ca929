"""The trend baseline experiment, and the structural contexts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import contexts as cx
from tidemark.operators import experiments as ex
from tidemark.operators import patterns as pt
from tidemark.plans.features import q_lag, recursive_sql
from tidemark.plans.strategy import BASE, EV, TREND_SMAS, market_benchmark, raw_breakouts, round_all
from tidemark.plans.timeframes import _greedy
from tidemark.sources.bars import derive_bars, with_bars


def trend_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir)
    return round_all(ex.trend_baseline(bars, pt.trend_contexts(bars, market_benchmark(bars))))


_RULES = {"t0": "TRUE", "t1": "c1", "t2": "c1 AND up", "t3": "c1 AND c3", "t4": "c1 AND c3 AND s50 > s200", "t5": "c1 AND up AND trail > 0", "t6": "c1 AND up AND trail - (b1 / b0 - 1) > 0"}
_ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in ("mean_return", "median_return", "positive_fraction", "median_mfe", "median_mae", "median_max_drawdown"))
BASELINE_SQL = recursive_sql(
    f"""SELECT context, horizon, coalesce(signals, 0) AS signals, coalesce(instruments, 0) AS instruments, coalesce(sample_size, 0) AS sample_size, {_ROUNDED}
FROM (SELECT context, horizon FROM (SELECT unnest({list(ex.CONTEXTS)}) AS context), (SELECT unnest({list(ex.HORIZONS)}) AS horizon))
LEFT JOIN (SELECT context, count(*) AS signals, count(DISTINCT instrument_id) AS instruments FROM marked GROUP BY 1) USING (context)
LEFT JOIN (SELECT context, horizon, count(*) AS sample_size, avg(r) AS mean_return, quantile_cont(r, 0.5) AS median_return, avg(CAST(r > 0 AS DOUBLE)) AS positive_fraction, quantile_cont(mfe, 0.5) AS median_mfe, quantile_cont(mae, 0.5) AS median_mae,
  quantile_cont(fall, 0.5) AS median_max_drawdown FROM sampled JOIN measured USING (instrument_id, signal_index) GROUP BY 1, 2) USING (context, horizon)""",
    BASE,
    TREND_SMAS,
    "market AS (SELECT trade_date, sum(cc) / count(*) / 100.0::DOUBLE AS b FROM bars GROUP BY 1)",
    f"""flagged AS MATERIALIZED (SELECT x.*, close > s200 AS c1, close > s50 AS c3, s200 > s200_then AS up, m1.b AS b1, m0.b AS b0
  FROM (SELECT *, close / {q_lag('close', 60)} - 1 AS trail, {q_lag('trade_date', 60)} AS then_date FROM trends) x LEFT JOIN market m1 ON m1.trade_date = x.trade_date LEFT JOIN market m0 ON m0.trade_date = x.then_date)""",
    "marked AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{k}' AS context, instrument_id, signal_index FROM flagged WHERE {v}" for k, v in _RULES.items()) + ")",
    _greedy("sampled", "marked", "context, instrument_id", "signal_index", ex.STRIDE),
    f"""walks AS (SELECT e.instrument_id, e.signal_index, off, b.close, first_value(b.open) OVER w AS entry, max(b.high) OVER w AS top, min(b.low) OVER w AS bottom, b.low, greatest(max(b.high) OVER w, first_value(b.open) OVER w) AS peak
  FROM (SELECT DISTINCT instrument_id, signal_index FROM sampled WHERE signal_index IS NOT NULL) e, (SELECT unnest(range(1, {max(ex.HORIZONS) + 1})) AS off), bars b WHERE b.instrument_id = e.instrument_id AND b.signal_index = e.signal_index + off
  WINDOW w AS (PARTITION BY e.instrument_id, e.signal_index ORDER BY off))""",
    f"measured AS MATERIALIZED (SELECT * FROM (SELECT instrument_id, signal_index, off AS horizon, close / entry - 1 AS r, top / entry - 1 AS mfe, bottom / entry - 1 AS mae, least(0, min(low / peak - 1) OVER (PARTITION BY instrument_id, signal_index ORDER BY off)) AS fall FROM walks) WHERE horizon IN {ex.HORIZONS})",
)

def event_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakouts with the context that they were sent, or else that of the twenty bars before."""
    hits, bars = raw_breakouts(spark, sf_dir)
    events = hits.withColumn("event_id", F.concat_ws(":", "instrument_id", F.col("trade_date").cast("string"))).withColumn("dataset_version", F.lit("v"))
    sent = events.where(F.dayofmonth("trade_date") % 2 == 0).select("event_id", "dataset_version", F.date_sub("trade_date", 30).alias("formation_start"), F.date_sub("trade_date", 1).alias("formation_end"), F.lit(1.0).alias("support"), F.lit(2.0).alias("resistance"))
    got = cx.with_context(events, sent, bars, 20)
    return round_all(got.select("event_id", "signal_index", "context", "formation_start", "formation_end", "support", "resistance"))


CONTEXTS_SQL = with_bars(
    """SELECT instrument_id || ':' || CAST(trade_date AS VARCHAR) AS event_id, signal_index, CASE WHEN sent THEN 'SUPPLIED' ELSE 'FORMATION' END AS context, CASE WHEN sent THEN trade_date - 30 ELSE a END AS formation_start, CASE WHEN sent THEN trade_date - 1 ELSE b END AS formation_end,
  CASE WHEN sent THEN 1.0::DOUBLE ELSE round(s, 8) END AS support, CASE WHEN sent THEN 2.0::DOUBLE ELSE round(r, 8) END AS resistance
FROM (SELECT ev.*, day(ev.trade_date) % 2 = 0 AS sent, a, b, s, r FROM ev JOIN (SELECT instrument_id, signal_index, min(trade_date) OVER w AS a, max(trade_date) OVER w AS b, min(low) OVER w AS s, max(high) OVER w AS r FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) f USING (instrument_id, signal_index))""",
    BASE,
    EV,
)

QUERIES = {"event_contexts": (event_contexts, CONTEXTS_SQL), "trend_baseline": (trend_baseline, BASELINE_SQL)}
