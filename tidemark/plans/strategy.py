"""Queries of signals, outcomes, exits, patterns, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import outcomes as oc
from tidemark.operators import patterns as pt
from tidemark.operators import resample as rs
from tidemark.operators import risk, signals
from tidemark.plans.features import MARKET, SMAS, SMAS_LAG, TR, P, q_full, q_lag, recursive_sql
from tidemark.sources.bars import FLAWED, corporate_actions, derive_bars, flawed, with_bars

HORIZONS = (5, 20)


def round_all(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with market features, rounded so that thresholds and ranks agree in every engine."""
    df = ind.with_market(derive_bars(spark, sf_dir))
    return df.select(*[c for c in df.columns if c not in ind.MARKET], *[F.round(c, 8).alias(c) for c in ind.MARKET])


FEATURED = "featured AS MATERIALIZED (SELECT instrument_id, trade_date, signal_index, open, high, low, close, " + ", ".join(f"round({x}, 8) AS {n}" for n, x in MARKET.items()) + " FROM lagged)"


def preset(name: str):
    expression, rank, descending, limit = signals.PRESETS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = signals.strategy_signals(featured(spark, sf_dir), expression, rank, descending, limit)
        return got.select("instrument_id", "trade_date", "signal_index", F.col(rank).alias("rank_value"), F.col("place").cast("long").alias("place"))

    return run


def _preset_cte(name: str, where: str) -> str:
    _, rank, descending, limit = signals.PRESETS[name]
    return f"""picked AS (SELECT * FROM (SELECT *, {rank} AS rank_value, row_number() OVER (PARTITION BY trade_date ORDER BY {rank} {'DESC' if descending else 'ASC'}, instrument_id) AS place
  FROM featured WHERE ({where}) AND {rank} IS NOT NULL) WHERE place <= {limit})"""


WHERE = {
    "prior_high_20": "distance_prior_high_20_pct > 0",
    "momentum_volume": "return_20 >= 0.05 AND relative_volume_20 >= 1.5 AND distance_sma_200_pct > 0",
    "pullback": "distance_sma_200_pct > 0 AND distance_sma_20_pct >= -5 AND distance_sma_20_pct < 0",
    "trend_cross": "sma_50_200_cross_up = 1",
    "range_low": "range_position_prior_20 < 0.2 AND return_5 IS NOT NULL AND NOT (return_5 > 0)",
    "year_momentum": "return_252 > 0",
}


def preset_sql(name: str) -> str:
    return with_bars("SELECT instrument_id, trade_date, signal_index, rank_value, place FROM picked", TR, SMAS, SMAS_LAG, FEATURED, _preset_cte(name, WHERE[name]))


def strategy_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets from one pass over the features."""
    return round_all(signals.strategy_family(featured(spark, sf_dir), signals.PRESETS)).withColumn("place", F.col("place").cast("long"))


FAMILY_SQL = with_bars(
    " UNION ALL ".join(
        f"SELECT '{name}' AS strategy, instrument_id, trade_date, signal_index, round(rank_value, 8) AS rank_value, place FROM (SELECT *, {rank} AS rank_value, row_number() OVER (PARTITION BY trade_date ORDER BY {rank} {'DESC' if descending else 'ASC'}, instrument_id) AS place FROM featured WHERE ({WHERE[name]}) AND {rank} IS NOT NULL) WHERE place <= {limit}"
        for name, (_, rank, descending, limit) in signals.PRESETS.items()
    ),
    TR, SMAS, SMAS_LAG, FEATURED,
)

SWEEP = (-0.1, -0.05, 0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 5.0)


def entry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-bar returns behind a 20-bar return of at least v."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = featured(spark, sf_dir).withColumn("later", F.lead("close", 20).over(w) / F.lead("open", 1).over(w) - 1)
    return round_all(signals.entry_sweep(rows, "return_20", list(SWEEP), "later"))


SWEEP_SQL = with_bars(
    f"""SELECT v AS value, count(return_20) AS signals, count(later) AS complete, round(avg(later), 8) AS mean_return, round(avg(CAST(later > 0 AS DOUBLE)), 8) AS positive_fraction
FROM (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in SWEEP)}) s(v) LEFT JOIN (SELECT return_20, lead(close, 20) OVER ({P}) / lead(open, 1) OVER ({P}) - 1 AS later FROM featured) ON return_20 >= v GROUP BY 1""",
    TR, SMAS, SMAS_LAG, FEATURED,
)


def prior_high_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the prior-high preset, by horizon: a research question from bars to answer."""
    bars = derive_bars(spark, sf_dir)
    expression, rank, descending, limit = signals.PRESETS["prior_high_20"]
    events = signals.strategy_signals(featured(spark, sf_dir), expression, rank, descending, limit).select("instrument_id", "signal_index", "trade_date")
    return round_all(oc.outcome_summary(oc.outcome_paths(events, bars, HORIZONS), HORIZONS))


def path_ctes(source: str = "bars", ok: str = "TRUE") -> str:
    """Paths of the events ``ev`` over a table of bars whose usable rows ``ok`` tells."""
    return f"""prior AS (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY signal_index) AS prev_close, {ok} AS ok FROM {source}),
walk AS MATERIALIZED (SELECT e.instrument_id, e.signal_index, e.trade_date AS signal_date, b.signal_index - e.signal_index AS off, b.trade_date AS bar_date, b.open, b.high, b.low, b.close,
    b.open / b.prev_close - 1 AS gap, b.ok, bool_and(b.ok) OVER (PARTITION BY e.instrument_id, e.signal_index ORDER BY b.signal_index) AS clean
  FROM ev e JOIN prior b ON b.instrument_id = e.instrument_id AND b.signal_index BETWEEN e.signal_index + 1 AND e.signal_index + 20),
flaws AS (SELECT instrument_id, signal_index, min(off) AS bad, arg_min(bar_date, off) AS bad_date FROM walk WHERE NOT ok GROUP BY 1, 2),
path AS (SELECT *, greatest(peak_before, high) AS peak_with
  FROM (SELECT *, greatest(entry, coalesce(max(high) OVER (PARTITION BY instrument_id, signal_index ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), entry)) AS peak_before
    FROM (SELECT *, first_value(open) OVER (PARTITION BY instrument_id, signal_index ORDER BY off) AS entry FROM walk WHERE clean)))"""


PATH = path_ctes()
OUTCOMES = """outs AS (
  SELECT e.instrument_id, e.signal_index, e.trade_date AS signal_date, e.horizon, s.entry,
    CASE WHEN bad = 1 THEN 'ENTRY_UNUSABLE' WHEN s.entry IS NULL THEN 'NO_ENTRY_BAR' WHEN seen = e.horizon THEN 'COMPLETE' WHEN bad <= e.horizon THEN 'TRUNCATED_UNUSABLE_BAR' ELSE 'TRUNCATED_END_OF_DATA' END AS status,
    coalesce(seen, 0) AS observed, CASE WHEN bad <= e.horizon THEN bad_date END AS truncated_on,
    CASE WHEN seen = e.horizon THEN last_close / s.entry - 1 END AS forward_return, last_close / s.entry - 1 AS partial_return,
    hi / s.entry - 1 AS mfe, mfe_offset, lo / s.entry - 1 AS mae, mae_offset,
    CASE WHEN mfe_offset < mae_offset THEN 'MFE_FIRST' WHEN mfe_offset > mae_offset THEN 'MAE_FIRST' WHEN mfe_offset IS NOT NULL THEN 'AMBIGUOUS' END AS first_extreme,
    drawdown_upper, drawdown_lower, CASE WHEN drawdown_upper IS NOT NULL THEN abs(drawdown_upper - drawdown_lower) > 1e-15 END AS drawdown_ambiguous,
    gap_up, gap_down, entry_gap, gap_up_date, gap_down_date
  FROM (SELECT ev.*, h.horizon FROM ev, (VALUES (5), (20)) h(horizon)) e
  LEFT JOIN (
    SELECT p.instrument_id, p.signal_index, h.horizon, any_value(entry) AS entry, max(off) AS seen, arg_max(close, off) AS last_close, max(high) AS hi,
      arg_max(off, (high, -off)) AS mfe_offset, min(low) AS lo, arg_min(off, (low, off)) AS mae_offset,
      min(low / peak_before - 1) AS drawdown_upper, min(low / peak_with - 1) AS drawdown_lower, greatest(max(gap), 0) AS gap_up, least(min(gap), 0) AS gap_down, arg_min(gap, off) AS entry_gap,
      arg_max(bar_date, (gap, -off)) FILTER (gap > 0) AS gap_up_date, arg_min(bar_date, (gap, off)) FILTER (gap < 0) AS gap_down_date
    FROM path p, (VALUES (5), (20)) h(horizon) WHERE off <= h.horizon GROUP BY 1, 2, 3) s
  ON s.instrument_id = e.instrument_id AND s.signal_index = e.signal_index AND s.horizon = e.horizon
  LEFT JOIN flaws f ON f.instrument_id = e.instrument_id AND f.signal_index = e.signal_index)"""
SUMMARY_BODY = """SELECT h.horizon, coalesce(n, 0) AS n, round(mean_return, 8) AS mean_return, round(median_return, 8) AS median_return, round(positive_fraction, 8) AS positive_fraction,
  round(p25, 8) AS p25, round(p75, 8) AS p75, round(median_mfe, 8) AS median_mfe, round(median_mae, 8) AS median_mae
FROM (VALUES (5), (20)) h(horizon) LEFT JOIN (
  SELECT horizon, count(*) AS n, avg(forward_return) AS mean_return, quantile_cont(forward_return, 0.5) AS median_return, avg(CAST(forward_return > 0 AS DOUBLE)) AS positive_fraction,
    quantile_cont(forward_return, 0.25) AS p25, quantile_cont(forward_return, 0.75) AS p75, quantile_cont(mfe, 0.5) AS median_mfe, quantile_cont(mae, 0.5) AS median_mae
  FROM outs WHERE status = 'COMPLETE' GROUP BY 1) s ON s.horizon = h.horizon"""
EV_PRESET = "ev AS (SELECT instrument_id, signal_index, trade_date FROM picked)"
SUMMARY_SQL = with_bars(SUMMARY_BODY, TR, SMAS, SMAS_LAG, FEATURED, _preset_cte("prior_high_20", WHERE["prior_high_20"]), EV_PRESET, PATH, OUTCOMES)

BASE = f"base AS MATERIALIZED (SELECT *, {q_full('max', 'hc', 20, -1)} AS hm, {q_full('min', 'lc', 20, -1)} AS lm FROM bars)"
EV = "ev AS MATERIALIZED (SELECT instrument_id, signal_index, trade_date FROM base WHERE (hm - lm) * 100 <= 8 * lm AND cc > hm)"


def raw_breakouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = derive_bars(spark, sf_dir)
    hits = pt.bases(bars, 20, 0.08, "NONE").where(F.col("qualified") & (F.col("cc") > F.col("hc_most")))
    return hits.select("instrument_id", "signal_index", "trade_date"), bars


def outcome_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return round_all(oc.outcome_paths(events, bars, HORIZONS))


def outcome_paths_flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events over bars of which some are in quarantine or not eligible."""
    events, bars = raw_breakouts(spark, sf_dir)
    return round_all(oc.outcome_paths(events, flawed(bars), HORIZONS))


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return round_all(oc.outcome_summary(oc.outcome_paths(events, bars, HORIZONS), HORIZONS))


OUT_COLUMNS = "instrument_id, signal_index, signal_date, horizon, round(entry, 8) AS entry, status, round(forward_return, 8) AS forward_return, round(partial_return, 8) AS partial_return, round(mfe, 8) AS mfe, mfe_offset, round(mae, 8) AS mae, mae_offset, first_extreme, round(drawdown_upper, 8) AS drawdown_upper, round(drawdown_lower, 8) AS drawdown_lower, drawdown_ambiguous, round(gap_up, 8) AS gap_up, round(gap_down, 8) AS gap_down, round(entry_gap, 8) AS entry_gap, gap_up_date, gap_down_date, observed, truncated_on"


def baseline_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth complete path of each instrument, greedily, and its 20-bar return."""
    bars = derive_bars(spark, sf_dir)
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = bars.withColumn("entry", F.lead("open", 1).over(w)).withColumn("last", F.lead("close", 20).over(w)).where("last is not null")
    return round_all(oc.stride(rows, 5).select("instrument_id", "signal_index", (F.col("last") / F.col("entry") - 1).alias("forward_return")))


STRIDE_SQL = recursive_sql(
    "SELECT r.instrument_id, r.signal_index, round(forward_return, 8) AS forward_return FROM taken t JOIN ret r ON r.instrument_id = t.instrument_id AND r.signal_index = t.signal_index",
    f"ret AS MATERIALIZED (SELECT instrument_id, signal_index, lead(close, 20) OVER ({P}) / lead(open, 1) OVER ({P}) - 1 AS forward_return FROM bars QUALIFY lead(close, 20) OVER ({P}) IS NOT NULL)",
    "taken AS (SELECT instrument_id, min(signal_index) AS signal_index FROM ret GROUP BY 1 UNION ALL SELECT t.instrument_id, (SELECT min(r.signal_index) FROM ret r WHERE r.instrument_id = t.instrument_id AND r.signal_index >= t.signal_index + 5) FROM taken t WHERE t.signal_index IS NOT NULL)",
)


def legacy_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pt.breakouts(derive_bars(spark, sf_dir))
    return round_all(got.select("instrument_id", "trade_date", "signal_index", (F.col("hc_most") / F.lit(100.0)).alias("resistance"), (F.col("lc_least") / F.lit(100.0)).alias("support"), F.col("ratio").alias("volume_ratio")))


LEGACY_SQL = recursive_sql(
    "SELECT b.instrument_id, b.trade_date, b.signal_index, round(hm / 100.0::DOUBLE, 8) AS resistance, round(lm / 100.0::DOUBLE, 8) AS support, round(volume / vm, 8) AS volume_ratio FROM taken t JOIN volumes b ON b.instrument_id = t.instrument_id AND b.signal_index = t.signal_index",
    BASE,
    EV,
    f"volumes AS (SELECT *, {q_full('avg', 'volume', 20, -1)} AS vm FROM base)",
    "taken AS (SELECT instrument_id, min(signal_index) AS signal_index FROM ev GROUP BY 1 UNION ALL SELECT t.instrument_id, (SELECT min(r.signal_index) FROM ev r WHERE r.instrument_id = t.instrument_id AND r.signal_index > t.signal_index + 5) FROM taken t WHERE t.signal_index IS NOT NULL)",
)


def qualified_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases that qualify under each trend filter, by instrument."""
    bars = derive_bars(spark, sf_dir)
    df = pt.bases(bars, 20, 0.08, "NONE")
    return df.where("qualified").groupBy("instrument_id").agg(*[F.count_if(pt.trend_ok(t)).alias(t.lower()) for t in pt.TRENDS])


TREND_SMAS = f"trends AS MATERIALIZED (SELECT *, {q_lag('s200', 20)} AS s200_then FROM (SELECT *, {q_full('avg', 'close', 50)} AS s50, {q_full('avg', 'close', 100)} AS s100, {q_full('avg', 'close', 200)} AS s200 FROM base))"
QUALIFIED_SQL = with_bars(
    """SELECT instrument_id, count(*) AS none, count(*) FILTER (close > s200) AS above_sma_200, count(*) FILTER (close > s200 AND s200 > s200_then) AS above_rising_sma_200,
  count(*) FILTER (close > s50 AND close > s100 AND close > s200) AS above_all, count(*) FILTER (close > s50 AND s50 > s100 AND s100 > s200) AS stacked
FROM trends WHERE (hm - lm) * 100 <= 8 * lm GROUP BY 1""",
    BASE,
    TREND_SMAS,
)


def market_benchmark(bars: DataFrame) -> DataFrame:
    return bars.groupBy("trade_date").agg((F.sum("cc") / F.count("*") / F.lit(100.0)).alias("benchmark_close"))


def trend_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir)
    got = pt.trend_contexts(bars, market_benchmark(bars))
    return got.groupBy("instrument_id").agg(*[F.count_if(f"t{i}").alias(f"t{i}") for i in range(7)])


CONTEXTS_SQL = with_bars(
    f"""SELECT instrument_id, count(*) AS t0, count(*) FILTER (t1) AS t1, count(*) FILTER (t1 AND up) AS t2, count(*) FILTER (t1 AND t3x) AS t3, count(*) FILTER (t1 AND t3x AND s50 > s200) AS t4,
  count(*) FILTER (t1 AND up AND trail > 0) AS t5, count(*) FILTER (t1 AND up AND trail - (b1 / b0 - 1) > 0) AS t6
FROM (SELECT x.*, close > s200 AS t1, close > s50 AS t3x, s200 > s200_then AS up, m1.b AS b1, m0.b AS b0
  FROM (SELECT *, close / {q_lag('close', 60)} - 1 AS trail, {q_lag('trade_date', 60)} AS then_date FROM trends) x
  LEFT JOIN market m1 ON m1.trade_date = x.trade_date LEFT JOIN market m0 ON m0.trade_date = x.then_date) GROUP BY 1""",
    BASE,
    TREND_SMAS,
    "market AS (SELECT trade_date, sum(cc) / count(*) / 100.0::DOUBLE AS b FROM bars GROUP BY 1)",
)


def exit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return round_all(risk.exit_results(events, bars, 20))


def exit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return round_all(risk.exit_summary(risk.exit_results(events, bars, 20)))


def premature_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return risk.premature_stops(risk.exit_results(events, bars, 20), oc.outcome_paths(events, bars, (20,)))


_POLICY_VALUES = ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else repr(x) if isinstance(x, str) else f"{x!r}::DOUBLE" for x in row) + ")" for row in risk.POLICIES)
EXITS = f"""levels AS (
  SELECT p.*, q.policy_id, CASE WHEN stop_pct IS NULL AND trail_pct IS NULL THEN NULL ELSE greatest(coalesce(entry * (1 - stop_pct), -1), coalesce(peak_before * (1 - trail_pct), -1)) END AS stop, entry * (1 + target_pct) AS target,
    min(low) OVER (PARTITION BY instrument_id, signal_index, policy_id ORDER BY off) AS low_most
  FROM (SELECT *, max(off) OVER (PARTITION BY instrument_id, signal_index) AS n FROM path) p, (VALUES {_POLICY_VALUES}) q(policy_id, stop_pct, trail_pct, target_pct) WHERE n = 20),
hits AS (SELECT *, coalesce(open <= stop, false) AS so, coalesce(low <= stop, false) AS sb, coalesce(open >= target, false) AS go, coalesce(high >= target, false) AS gb FROM levels),
exits AS MATERIALIZED (
  SELECT instrument_id, signal_index, signal_date, policy_id, entry, off AS exit_offset, bar_date AS exit_date,
    CASE WHEN so THEN 'STOP' WHEN go THEN 'TARGET' WHEN sb THEN 'STOP' WHEN gb THEN 'TARGET' ELSE 'HORIZON' END AS reason,
    CASE WHEN so OR go THEN open WHEN sb THEN stop WHEN gb THEN target ELSE close END AS exit_price, sb AND gb AND NOT so AND NOT go AS ambiguous, low_most
  FROM hits WHERE so OR sb OR go OR gb OR off = 20
  QUALIFY row_number() OVER (PARTITION BY instrument_id, signal_index, policy_id ORDER BY off) = 1)"""
EXIT_SQL = with_bars("SELECT instrument_id, signal_index, signal_date, policy_id, round(entry, 8) AS entry, exit_offset, exit_date, reason, round(exit_price, 8) AS exit_price, ambiguous, round(exit_price / entry - 1, 8) AS net_return, round(low_most / entry - 1, 8) AS mae_to_exit FROM exits", BASE, EV, PATH, EXITS)
EXIT_SUMMARY_SQL = with_bars(
    """SELECT policy_id, n, round(stop_rate, 8) AS stop_rate, round(target_rate, 8) AS target_rate, round(ambiguous_rate, 8) AS ambiguous_rate, round(expectancy, 8) AS expectancy, round(median_return, 8) AS median_return,
  round(win_rate, 8) AS win_rate, round(payoff, 8) AS payoff, round(profit_factor, 8) AS profit_factor, round(p05, 8) AS p05, round(holding_bars, 8) AS holding_bars, round(median_mae, 8) AS median_mae,
  round(expectancy - max(CASE WHEN policy_id = 'hold' THEN expectancy END) OVER (), 8) AS delta_vs_hold
FROM (SELECT policy_id, count(*) AS n, avg(CAST(reason = 'STOP' AS DOUBLE)) AS stop_rate, avg(CAST(reason = 'TARGET' AS DOUBLE)) AS target_rate, avg(CAST(ambiguous AS DOUBLE)) AS ambiguous_rate, avg(r) AS expectancy,
  quantile_cont(r, 0.5) AS median_return, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, avg(r) FILTER (r > 0) / -avg(r) FILTER (r < 0) AS payoff, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor,
  quantile_cont(r, 0.05) AS p05, avg(exit_offset) AS holding_bars, quantile_cont(low_most / entry - 1, 0.5) AS median_mae
  FROM (SELECT *, exit_price / entry - 1 AS r FROM exits) GROUP BY 1)""",
    BASE, EV, PATH, EXITS,
)
PREMATURE_SQL = with_bars(
    "SELECT policy_id, count(*) AS stopped, count(*) FILTER (forward_return > 0) AS premature FROM exits x JOIN outs o ON o.instrument_id = x.instrument_id AND o.signal_index = x.signal_index AND o.horizon = 20 WHERE reason = 'STOP' GROUP BY 1",
    BASE, EV, PATH, OUTCOMES, EXITS,
)


def resampled(sessions: int | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rs.resample(derive_bars(spark, sf_dir), sessions)

    return run


def resample_sql(sessions: int | None) -> str:
    if sessions is None:
        blocks = """blocks AS (SELECT d.trade_date, block, n FROM (SELECT trade_date, CAST(isoyear(trade_date) * 100 + week(trade_date) AS BIGINT) AS block FROM days) d
  JOIN (SELECT CAST(isoyear(trade_date) * 100 + week(trade_date) AS BIGINT) AS block, count(*) AS n, max(trade_date) AS last FROM days GROUP BY 1) s USING (block)
  WHERE last < (SELECT max(trade_date) FROM days) OR isodow((SELECT max(trade_date) FROM days)) = 5)"""
    else:
        blocks = f"blocks AS (SELECT trade_date, block, count(*) OVER (PARTITION BY block) AS n FROM (SELECT trade_date, CAST((row_number() OVER (ORDER BY trade_date) - 1) // {sessions} AS BIGINT) AS block FROM days) QUALIFY n = {sessions})"
    return with_bars(
        """SELECT instrument_id, block, min(trade_date) AS first_date, max(b.trade_date) AS trade_date, arg_min(open, b.trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.trade_date) AS close,
  sum(volume) AS volume, min(signal_index) AS source_start, max(signal_index) AS source_end FROM bars b JOIN blocks k USING (trade_date) GROUP BY instrument_id, block, n HAVING count(*) = n""",
        "days AS (SELECT DISTINCT trade_date FROM bars)",
        blocks,
    )


#: Settings of the registered life cycle: with a volume gate, so that some closes above resistance are no events.
LIFECYCLE = pt.Lifecycle(volume_ratio=1.0, max_age=60)


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.lifecycle_states(flawed(derive_bars(spark, sf_dir)), LIFECYCLE, corporate_actions(spark, sf_dir))


def lifecycle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States over bars of which some are unusable, with corporate actions."""
    return _life(spark, sf_dir)


def pattern_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(pt.lifecycle_events(_life(spark, sf_dir)))


def latest_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.projection(_life(spark, sf_dir), LIFECYCLE)


def scanner_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.state_counts(pt.latest_states(pt.lifecycle_states(derive_bars(spark, sf_dir)), "1997-06-30"))


QUERIES = {
    "strategy_prior_high_20_signals": (preset("prior_high_20"), preset_sql("prior_high_20")),
    "strategy_prior_high_20_summary": (prior_high_summary, SUMMARY_SQL),
    **{f"strategy_{n}": (preset(n), preset_sql(n)) for n in ("momentum_volume", "pullback", "trend_cross", "range_low", "year_momentum")},
    "strategy_family": (strategy_family, FAMILY_SQL),
    "entry_sweep": (entry_sweep, SWEEP_SQL),
    "outcome_paths": (outcome_paths, with_bars(f"SELECT {OUT_COLUMNS} FROM outs", BASE, EV, PATH, OUTCOMES)),
    "outcome_paths_flawed": (outcome_paths_flawed, with_bars(f"SELECT {OUT_COLUMNS} FROM outs", BASE, EV, FLAWED, path_ctes("flawed", "usable"), OUTCOMES)),
    "outcome_summary": (outcome_summary, with_bars(SUMMARY_BODY, BASE, EV, PATH, OUTCOMES)),
    "baseline_stride_returns": (baseline_stride, STRIDE_SQL),
    "legacy_breakouts": (legacy_breakouts, LEGACY_SQL),
    "qualified_patterns": (qualified_patterns, QUALIFIED_SQL),
    "trend_contexts": (trend_contexts, CONTEXTS_SQL),
    "exit_policy_results": (exit_results, EXIT_SQL),
    "exit_policy_summary": (exit_summary, EXIT_SUMMARY_SQL),
    "premature_stops": (premature_stops, PREMATURE_SQL),
    "resample_two_session": (resampled(2), resample_sql(2)),
    "resample_three_session": (resampled(3), resample_sql(3)),
    "resample_weekly": (resampled(None), resample_sql(None)),
    "pattern_lifecycle_states": (lifecycle_states, None),
    "pattern_events": (pattern_events, None),
    "latest_projection": (latest_projection, None),
    "scanner_state_counts": (scanner_state_counts, None),
}
