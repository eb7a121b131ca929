"""Queries of patterns on block bars with outcomes on days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import timeframes as tf
from tidemark.plans.features import recursive_sql
from tidemark.plans.strategy import round_all
from tidemark.sources.bars import derive_bars, flawed, with_bars

FRAMES = {"two_session": 2, "three_session": 3, "weekly": None}
HORIZONS, DURATION, RANGE, COOLDOWN, GAP = (5, 10, 20, 40, 60), 10, 12, 5, 5


def block_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars over days of which some are in quarantine or not eligible."""
    got = tf.block_bars(flawed(derive_bars(spark, sf_dir)), None)
    return round_all(got.select("instrument_id", "trade_date", "first_date", "open", "high", "low", "close", "volume", "eligibility", "quality_status", "signal_index", "source_start", "source_end"))


def timeframe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, out = derive_bars(spark, sf_dir), None
    for name, sessions in FRAMES.items():
        one = tf.events(tf.block_bars(bars, sessions), bars, name, DURATION, RANGE / 100, "NONE", COOLDOWN).select(F.lit(name).alias("timeframe"), "instrument_id", "trade_date", "block_index", "signal_index", "event_id")
        out = one if out is None else out.unionByName(one)
    return out


def timeframe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(tf.report(derive_bars(spark, sf_dir), FRAMES, HORIZONS, DURATION, RANGE / 100, "NONE", COOLDOWN, GAP))


def _calendar(name: str, sessions: int | None) -> str:
    if sessions is None:
        return f"""{name} AS (SELECT d.trade_date, block, n FROM (SELECT trade_date, CAST(isoyear(trade_date) * 100 + week(trade_date) AS BIGINT) AS block FROM days) d
  JOIN (SELECT CAST(isoyear(trade_date) * 100 + week(trade_date) AS BIGINT) AS block, count(*) AS n, max(trade_date) AS last FROM days GROUP BY 1) s USING (block)
  WHERE last < (SELECT max(trade_date) FROM days) OR isodow((SELECT max(trade_date) FROM days)) = 5)"""
    return f"{name} AS (SELECT trade_date, block, count(*) OVER (PARTITION BY block) AS n FROM (SELECT trade_date, CAST((row_number() OVER (ORDER BY trade_date) - 1) // {sessions} AS BIGINT) AS block FROM days) QUALIFY n = {sessions})"


DAYS = "days AS (SELECT DISTINCT trade_date FROM bars)"
QUALITY_SQL = with_bars(
    """SELECT instrument_id, trade_date, first_date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume, eligibility, CASE WHEN bad THEN 'QUARANTINE' ELSE 'PASS' END AS quality_status,
  row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) - 1 AS signal_index, source_start, source_end
FROM (SELECT instrument_id, max(b.trade_date) AS trade_date, min(b.trade_date) AS first_date, arg_min(open, b.trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.trade_date) AS close, sum(volume) AS volume,
  bool_and(dayofyear(b.trade_date) % 29 <> 0) AS eligibility, bool_or(dayofyear(b.trade_date) % 31 = 0) AS bad, min(signal_index) AS source_start, max(signal_index) AS source_end
  FROM bars b JOIN blocks k USING (trade_date) GROUP BY instrument_id, block, n HAVING count(*) = n)""",
    DAYS,
    _calendar("blocks", None),
)


def _greedy(name: str, source: str, key: str, at: str, gap: int) -> str:
    on = " AND ".join(f"r.{k} = t.{k}" for k in key.split(", "))
    return f"{name} AS (SELECT {key}, min({at}) AS {at} FROM {source} GROUP BY ALL UNION ALL SELECT {', '.join('t.' + k for k in key.split(', '))}, (SELECT min(r.{at}) FROM {source} r WHERE {on} AND r.{at} >= t.{at} + {gap}) FROM {name} t WHERE t.{at} IS NOT NULL)"


_RETURNS = ", ".join(f"lead(close, {h}) OVER w / lead(open, 1) OVER w - 1 AS r_{h}" for h in HORIZONS)
_CTES = (
    DAYS,
    *[_calendar(f"cal_{n}", s) for n, s in FRAMES.items()],
    "cals AS (" + " UNION ALL ".join(f"SELECT '{n}' AS timeframe, * FROM cal_{n}" for n in FRAMES) + ")",
    """blocks AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY timeframe, instrument_id ORDER BY trade_date) - 1 AS block_index FROM (
  SELECT timeframe, instrument_id, max(b.trade_date) AS trade_date, max(hc) AS hc, min(lc) AS lc, arg_max(cc, b.trade_date) AS cc, max(signal_index) AS signal_index FROM bars b JOIN cals k USING (trade_date) GROUP BY timeframe, instrument_id, block, n HAVING count(*) = n))""",
    f"""hits AS MATERIALIZED (SELECT * FROM (SELECT *, max(hc) OVER w AS hm, min(lc) OVER w AS lm FROM blocks WINDOW w AS (PARTITION BY timeframe, instrument_id ORDER BY trade_date ROWS BETWEEN {DURATION} PRECEDING AND 1 PRECEDING))
  WHERE block_index >= {DURATION} AND cc > hm AND (hm - lm) * 100 <= {RANGE} * lm)""",
    _greedy("taken", "hits", "timeframe, instrument_id", "block_index", COOLDOWN + 1),
    "found AS MATERIALIZED (SELECT hits.* FROM taken JOIN hits USING (timeframe, instrument_id, block_index))",
)
EVENTS_SQL = recursive_sql("SELECT timeframe, instrument_id, trade_date, block_index, signal_index, instrument_id || ':' || CAST(trade_date AS VARCHAR) || ':pattern_timeframe=' || timeframe AS event_id FROM found", *_CTES)
REPORT_SQL = recursive_sql(
    """SELECT timeframe, horizon, coalesce(events, 0) AS events, coalesce(complete, 0) AS complete, round(mean_return, 8) AS mean_return, round(median_return, 8) AS median_return, round(positive_fraction, 8) AS positive_fraction, coalesce(baseline_n, 0) AS baseline_n, round(baseline_mean, 8) AS baseline_mean,
  round(mean_return - baseline_mean, 8) AS excess, round(coalesce(with_events, 0) / CAST((SELECT count(DISTINCT instrument_id) FROM bars) AS DOUBLE), 8) AS breadth, round(top / CAST(events AS DOUBLE), 8) AS top5_share, coalesce(active_months, 0) AS active_months
FROM (SELECT timeframe, horizon FROM (VALUES ('two_session'), ('three_session'), ('weekly')) f(timeframe), (SELECT unnest([5, 10, 20, 40, 60]) AS horizon))
LEFT JOIN (SELECT timeframe, horizon, count(r) AS complete, avg(r) AS mean_return, quantile_cont(r, 0.5) AS median_return, avg(CAST(r > 0 AS DOUBLE)) AS positive_fraction FROM found JOIN long USING (instrument_id, signal_index) GROUP BY 1, 2) USING (timeframe, horizon)
LEFT JOIN (SELECT timeframe, horizon, count(*) AS baseline_n, avg(r) AS baseline_mean FROM thinned JOIN candidates USING (timeframe, horizon, instrument_id, block_index) GROUP BY 1, 2) USING (timeframe, horizon)
LEFT JOIN (SELECT timeframe, sum(n) AS events, count(*) AS with_events, list_sum(list_reverse_sort(list(n))[1:5]) AS top FROM (SELECT timeframe, instrument_id, count(*) AS n FROM found GROUP BY 1, 2) GROUP BY 1) USING (timeframe)
LEFT JOIN (SELECT timeframe, count(DISTINCT strftime(trade_date, '%Y-%m')) AS active_months FROM found GROUP BY 1) USING (timeframe)""",
    *_CTES,
    f"rets AS MATERIALIZED (SELECT *, {_RETURNS} FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date))",
    "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT instrument_id, signal_index, {h} AS horizon, r_{h} AS r FROM rets" for h in HORIZONS) + ")",
    "candidates AS MATERIALIZED (SELECT timeframe, instrument_id, block_index, horizon, r FROM blocks JOIN long USING (instrument_id, signal_index) WHERE r IS NOT NULL)",
    _greedy("thinned", "candidates", "timeframe, horizon, instrument_id", "block_index", GAP),
)

QUERIES = {"block_quality": (block_quality, QUALITY_SQL), "timeframe_events": (timeframe_events, EVENTS_SQL), "timeframe_report": (timeframe_report, REPORT_SQL)}
