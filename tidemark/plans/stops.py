"""Queries of initial stops and managed exits: results of the grids, summaries, the common population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import patterns as pt
from tidemark.operators import exits, stops
from tidemark.plans.features import TR, q_full
from tidemark.plans.strategy import path_ctes, round_all
from tidemark.sources.bars import FLAWED, derive_bars, flawed, with_bars

HORIZON, REACH = 20, 0.05
COSTS = stops.Costs(5.0, 5.0, 10.0, 1.0)


def contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Breakouts with the base's support and resistance and the ATR at the signal; and bars of which some are unusable."""
    bars = derive_bars(spark, sf_dir)
    base = pt.bases(bars.withColumn("tr", ind.true_range()), 20, 0.08, "NONE").withColumn("atr", F.when(F.col("signal_index") >= 14, ind.atr(14)))
    hits = base.where(F.col("qualified") & (F.col("cc") > F.col("hc_most")))
    events = hits.select("instrument_id", "signal_index", "trade_date", (F.col("lc_least") / F.lit(100.0)).alias("support"), (F.col("hc_most") / F.lit(100.0)).alias("resistance"), "atr")
    return events, flawed(bars)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = contexts(spark, sf_dir)
    return stops.stop_results(events, bars, HORIZON, costs=COSTS, reach=REACH)


def stop_policy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event under every policy of the grid."""
    return round_all(results(spark, sf_dir))


def stop_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(stops.stop_summary(results(spark, sf_dir)))


def stop_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested events, and which the comparison evaluates."""
    return stops.comparison_population(contexts(spark, sf_dir)[0], results(spark, sf_dir))


_VALUES = ", ".join(f"('{i}', '{f}', {z!r}::DOUBLE)" for i, f, z in stops.POLICIES)
EVENTS = f"""base AS MATERIALIZED (SELECT *, {q_full('max', 'hc', 20, -1)} AS hm, {q_full('min', 'lc', 20, -1)} AS lm, CASE WHEN signal_index >= 14 THEN {q_full('avg', 'tr', 14)} END AS atr FROM tr),
ev AS MATERIALIZED (SELECT instrument_id, signal_index, trade_date, lm / 100.0::DOUBLE AS support, hm / 100.0::DOUBLE AS resistance, atr FROM base WHERE (hm - lm) * 100 <= 8 * lm AND cc > hm)"""
_PAY, _LEAVE, _STOP = (f"{1 + (COSTS.entry_slippage + COSTS.commission) / 1e4!r}", f"(1 - {COSTS.exit_slippage + COSTS.commission!r} / 10000)", f"(1 - {COSTS.exit_slippage + COSTS.commission + COSTS.stop_slippage!r} / 10000)")
RESULTS = f"""whole AS (SELECT instrument_id, signal_index, arg_min(open, off) AS entry, arg_max(close, off) AS last, max(high) AS top FROM walk GROUP BY 1, 2 HAVING count(*) = {HORIZON} AND bool_and(ok)),
levels AS (SELECT w.*, q.*, CASE family WHEN 'FIXED_PERCENT' THEN entry * (1 - size) WHEN 'ATR' THEN entry - size * atr WHEN 'STRUCTURAL_BASE_LOW' THEN support
    WHEN 'STRUCTURAL_BOUNDARY' THEN CASE WHEN size = 0 THEN resistance ELSE resistance - size * atr END WHEN 'HYBRID_STRUCTURAL_ATR' THEN CASE WHEN atr IS NOT NULL THEN least(support, entry - size * atr) END END AS stop
  FROM whole w JOIN ev USING (instrument_id, signal_index), (VALUES {_VALUES}) q(policy_id, family, size)),
full_set AS (SELECT * FROM levels QUALIFY bool_and(family = 'NO_STOP' OR stop IS NOT NULL) OVER (PARTITION BY instrument_id, signal_index)),
hits AS (SELECT l.instrument_id, l.signal_index, l.policy_id, min(off) AS hit, arg_min(open, off) AS hit_open FROM full_set l JOIN walk p ON p.instrument_id = l.instrument_id AND p.signal_index = l.signal_index
  WHERE l.stop < l.entry AND (p.open <= l.stop OR p.low <= l.stop) GROUP BY 1, 2, 3),
held AS (SELECT l.*, coalesce(stop >= entry, FALSE) AS at_once, hit, hit_open, coalesce(stop >= entry, FALSE) OR hit IS NOT NULL AS stopped, coalesce(hit_open <= stop, FALSE) AS gapped,
    CASE WHEN stop >= entry THEN 1 ELSE coalesce(hit, {HORIZON}) END AS holding FROM full_set l LEFT JOIN hits USING (instrument_id, signal_index, policy_id)),
priced AS (SELECT *, CASE WHEN at_once THEN entry WHEN gapped THEN hit_open WHEN stopped THEN stop ELSE last END AS market_exit, entry * {_PAY} AS paid FROM held),
netted AS (SELECT *, market_exit * CASE WHEN stopped THEN {_STOP} ELSE {_LEAVE} END / paid - 1 AS realized_return, last * {_LEAVE} / paid - 1 AS no_stop_return, market_exit / entry - 1 AS gross_return,
    CASE WHEN stop < entry THEN (entry - stop) / entry END AS initial_risk FROM priced),
seen AS (SELECT n.instrument_id, n.signal_index, n.policy_id, min(low) FILTER (off <= holding) AS low_most, max(high) FILTER (off >= holding) AS high_behind, bool_or(off = holding AND high >= entry * {1 + REACH!r}) AS own,
    bool_or(off > holding AND high >= entry * {1 + REACH!r}) AS later, max(bar_date) FILTER (off = holding) AS exit_date FROM netted n JOIN walk p ON p.instrument_id = n.instrument_id AND p.signal_index = n.signal_index GROUP BY 1, 2, 3),
results AS (SELECT n.instrument_id, n.signal_index, n.policy_id, family, entry, stop AS initial_stop, CASE WHEN at_once THEN 'ENTRY_AT_OR_BELOW_STOP' WHEN stopped THEN 'STOP' ELSE 'RESEARCH_HORIZON' END AS reason, exit_date, market_exit,
    gross_return, realized_return, gross_return - realized_return AS cost_drag, initial_risk, realized_return / initial_risk AS realized_r, stopped,
    CASE WHEN NOT stopped THEN 'NOT_APPLICABLE' WHEN no_stop_return > 0 THEN 'YES' ELSE 'NO' END AS premature,
    CASE WHEN NOT stopped THEN 'NOT_APPLICABLE' WHEN own THEN 'SAME_BAR_AMBIGUOUS' WHEN later THEN 'YES' ELSE 'NO' END AS reached,
    gapped AS gap_through, CASE WHEN gapped THEN (stop - hit_open) / entry ELSE 0.0::DOUBLE END AS gap_loss, holding AS holding_sessions, low_most / entry - 1 AS mae_before_exit, top / entry - 1 AS mfe_full,
    CASE WHEN stopped THEN high_behind / entry - 1 END AS post_stop_mfe, no_stop_return FROM netted n JOIN seen USING (instrument_id, signal_index, policy_id))"""
_DOUBLES = ("entry", "initial_stop", "market_exit", "gross_return", "realized_return", "cost_drag", "initial_risk", "realized_r", "gap_loss", "mae_before_exit", "mfe_full", "post_stop_mfe", "no_stop_return")
_CTES = (TR, EVENTS, FLAWED, path_ctes("flawed", "usable"), RESULTS)
RESULTS_SQL = with_bars("SELECT instrument_id, signal_index, policy_id, family, reason, exit_date, stopped, premature, reached, gap_through, holding_sessions, " + ", ".join(f"round({x}, 8) AS {x}" for x in _DOUBLES) + " FROM results", *_CTES)
_METRICS = {
    "stop_out_rate": "avg(CAST(stopped AS DOUBLE))", "expectancy": "avg(r)", "delta_vs_no_stop": "avg(r) - avg(no_stop_return)", "median_return": "quantile_cont(r, 0.5)", "win_probability": "avg(CAST(r > 0 AS DOUBLE))",
    "average_winner": "avg(r) FILTER (r > 0)", "median_winner": "quantile_cont(r, 0.5) FILTER (r > 0)", "average_loser": "avg(r) FILTER (r < 0)", "median_loser": "quantile_cont(r, 0.5) FILTER (r < 0)", "profit_factor": "sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0)",
    "average_r": "avg(realized_r)", "median_r": "quantile_cont(realized_r, 0.5)", "premature_lower": "avg(CAST(reached = 'YES' AS DOUBLE)) FILTER (stopped)", "premature_upper": "avg(CAST(reached <> 'NO' AS DOUBLE)) FILTER (stopped)",
    "premature_ambiguous": "avg(CAST(reached = 'SAME_BAR_AMBIGUOUS' AS DOUBLE)) FILTER (stopped)", "gap_through_rate": "avg(CAST(gap_through AS DOUBLE)) FILTER (stopped)", "mean_gap_loss": "avg(gap_loss) FILTER (gap_through)", "tail_p05": "quantile_cont(r, 0.05)",
    "holding_sessions": "avg(holding_sessions)", "median_mae": "quantile_cont(mae_before_exit, 0.5)", "median_mfe": "quantile_cont(mfe_full, 0.5)", "mean_initial_risk": "avg(initial_risk)", "mean_cost_drag": "avg(cost_drag)",
}
SUMMARY_SQL = with_bars("SELECT policy_id, family, count(*) AS n, count(*) FILTER (stopped) AS stop_outs, " + ", ".join(f"round({x}, 8) AS {n}" for n, x in _METRICS.items()) + " FROM (SELECT *, realized_return AS r FROM results) GROUP BY 1, 2", *_CTES)
POPULATION_SQL = with_bars("SELECT instrument_id, signal_index, (instrument_id, signal_index) IN (SELECT (instrument_id, signal_index) FROM results) AS evaluated FROM ev", *_CTES)



def managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = contexts(spark, sf_dir)
    return exits.exit_results(events, bars, HORIZON, costs=COSTS)


def managed_exit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event under every exit policy."""
    return round_all(managed(spark, sf_dir))


def managed_exit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(exits.exit_summary(managed(spark, sf_dir)))


_EXITS = ", ".join(f"('{i}', '{f}', {z!r}::DOUBLE, '{g}', {y!r}::DOUBLE, {first})" for i, f, z, g, y, first in exits.POLICIES)
MANAGED = f"""whole AS (SELECT w.instrument_id, w.signal_index, any_value(e.atr) AS atr, arg_min(open, off) AS entry, arg_max(close, off) AS last, arg_max(bar_date, off) AS last_date, max(high) AS top
  FROM walk w JOIN ev e USING (instrument_id, signal_index) GROUP BY 1, 2 HAVING count(*) = {HORIZON} AND bool_and(ok) AND any_value(e.atr) IS NOT NULL),
plans AS (SELECT *, CASE goal_family WHEN 'PERCENT' THEN entry * (1 + goal_size) WHEN 'ATR' THEN entry + goal_size * atr WHEN 'R' THEN CASE WHEN stop < entry THEN entry + goal_size * (entry - stop) END END AS goal
  FROM (SELECT w.*, q.*, CASE WHEN family IN ('FIXED_PERCENT', 'TRAILING_PERCENT') THEN entry * (1 - size) WHEN family <> 'HOLD' THEN entry - size * atr END AS stop
    FROM whole w, (VALUES {_EXITS}) q(policy_id, family, size, goal_family, goal_size, stop_first))),
marks AS (SELECT *, CASE family WHEN 'TRAILING_PERCENT' THEN greatest(stop, peak * (1 - size)) WHEN 'TRAILING_ATR' THEN greatest(stop, peak - size * atr) ELSE stop END AS level
  FROM (SELECT p.*, off, open, high, low, bar_date, greatest(entry, max(high) OVER (PARTITION BY p.instrument_id, p.signal_index, policy_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak
    FROM plans p JOIN walk w ON w.instrument_id = p.instrument_id AND w.signal_index = p.signal_index)),
touched AS (SELECT *, coalesce(open <= level, FALSE) AS stop_open, coalesce(low <= level OR open <= level, FALSE) AS stop_any, coalesce(open >= goal, FALSE) AS goal_open, coalesce(high >= goal OR open >= goal, FALSE) AS goal_any FROM marks),
firsts AS (SELECT * FROM touched WHERE stop_any OR goal_any QUALIFY row_number() OVER (PARTITION BY instrument_id, signal_index, policy_id ORDER BY off) = 1),
ends AS (SELECT p.*, off, open, bar_date, level, coalesce(stop_any AND goal_any AND stop_open = goal_open, FALSE) AS ambiguous, coalesce(stop_open, FALSE) AS at_open,
    coalesce(CASE WHEN stop_any AND goal_any AND stop_open = goal_open THEN p.stop_first ELSE stop_any AND (NOT goal_any OR stop_open) END, FALSE) AS stopped FROM plans p LEFT JOIN firsts f USING (instrument_id, signal_index, policy_id)),
priced AS (SELECT *, CASE WHEN stopped THEN least(open, level) WHEN off IS NOT NULL THEN greatest(open, goal) ELSE last END AS market_exit, coalesce(off, {HORIZON}) AS holding FROM ends),
lows AS (SELECT p.instrument_id, p.signal_index, p.policy_id, min(low) AS low_most FROM priced p JOIN walk w ON w.instrument_id = p.instrument_id AND w.signal_index = p.signal_index AND w.off <= p.holding GROUP BY 1, 2, 3),
results AS (SELECT p.instrument_id, p.signal_index, p.policy_id, family, entry, stop AS initial_stop, goal AS initial_target, CASE WHEN stopped THEN 'STOP' WHEN off IS NOT NULL THEN 'TARGET' ELSE 'RESEARCH_HORIZON' END AS reason,
    coalesce(bar_date, last_date) AS exit_date, market_exit, ambiguous, market_exit / entry - 1 AS gross_return, market_exit * CASE WHEN stopped THEN {_STOP} ELSE {_LEAVE} END / (entry * {_PAY}) - 1 AS realized_return,
    (market_exit / entry - 1) - (market_exit * CASE WHEN stopped THEN {_STOP} ELSE {_LEAVE} END / (entry * {_PAY}) - 1) AS cost_drag, last * {_LEAVE} / (entry * {_PAY}) - 1 AS hold_return, stopped AND at_open AS gap_through,
    CASE WHEN stopped AND at_open THEN greatest(0.0::DOUBLE, (level - open) / entry) ELSE 0.0::DOUBLE END AS gap_loss, holding AS holding_sessions, low_most / entry - 1 AS mae_before_exit, top / entry - 1 AS mfe_full FROM priced p JOIN lows USING (instrument_id, signal_index, policy_id))"""
_EXIT_DOUBLES = ("entry", "initial_stop", "initial_target", "market_exit", "gross_return", "realized_return", "cost_drag", "hold_return", "gap_loss", "mae_before_exit", "mfe_full")
_EXIT_CTES = (TR, EVENTS, FLAWED, path_ctes("flawed", "usable"), MANAGED)
MANAGED_SQL = with_bars("SELECT instrument_id, signal_index, policy_id, family, reason, exit_date, ambiguous, gap_through, holding_sessions, " + ", ".join(f"round({x}, 8) AS {x}" for x in _EXIT_DOUBLES) + " FROM results", *_EXIT_CTES)
_EXIT_METRICS = {
    "stop_rate": "avg(CAST(reason = 'STOP' AS DOUBLE))", "target_rate": "avg(CAST(reason = 'TARGET' AS DOUBLE))", "ambiguous_rate": "avg(CAST(ambiguous AS DOUBLE))", "expectancy": "avg(r)", "delta_vs_hold": "avg(r) - avg(hold_return)",
    "median_return": "quantile_cont(r, 0.5)", "win_probability": "avg(CAST(r > 0 AS DOUBLE))", "average_winner": "avg(r) FILTER (r > 0)", "average_loser": "avg(r) FILTER (r < 0)", "payoff": "avg(r) FILTER (r > 0) / -avg(r) FILTER (r < 0)",
    "profit_factor": "sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0)", "tail_p05": "quantile_cont(r, 0.05)", "holding_sessions": "avg(holding_sessions)", "median_holding": "quantile_cont(CAST(holding_sessions AS DOUBLE), 0.5)", "median_mae": "quantile_cont(mae_before_exit, 0.5)",
    "median_mfe": "quantile_cont(mfe_full, 0.5)", "gap_rate": "avg(CAST(gap_through AS DOUBLE))", "mean_gap_loss": "avg(gap_loss) FILTER (gap_through)", "mean_cost_drag": "avg(cost_drag)",
}
MANAGED_SUMMARY_SQL = with_bars("SELECT policy_id, family, count(*) AS n, " + ", ".join(f"round({x}, 8) AS {n}" for n, x in _EXIT_METRICS.items()) + " FROM (SELECT *, realized_return AS r FROM results) GROUP BY 1, 2", *_EXIT_CTES)

QUERIES = {
    "stop_policy_results": (stop_policy_results, RESULTS_SQL),
    "stop_policy_summary": (stop_policy_summary, SUMMARY_SQL),
    "stop_population": (stop_population, POPULATION_SQL),
    "managed_exit_results": (managed_exit_results, MANAGED_SQL),
    "managed_exit_summary": (managed_exit_summary, MANAGED_SUMMARY_SQL),
}
