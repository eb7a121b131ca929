"""Queries of reports, sample accounting, experiment tables, dividends and the full rule set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import patterns as pt
from tidemark.operators import quality as ql
from tidemark.operators import reports as rp
from tidemark.operators import statistics as st
from tidemark.plans import data, research, strategy
from tidemark.plans.features import P, q_full, recursive_sql
from tidemark.plans.strategy import BASE, EV, HORIZONS, OUTCOMES, path_ctes, raw_breakouts, round_all
from tidemark.sources.bars import ACTIONS_CTE, FLAWED, corporate_actions, derive_bars, flawed, second_provider, table, with_bars

FLAWED_OUTS = (BASE, EV, FLAWED, path_ctes("flawed", "usable"), OUTCOMES)


def flawed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return oc.outcome_paths(events, flawed(bars), HORIZONS)


def edge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakouts of each instrument, 20 bars on, against every fifth bar of it."""
    events, bars = raw_breakouts(spark, sf_dir)
    done = oc.outcome_paths(events, bars, (20,)).where("status = 'COMPLETE'")
    return round_all(rp.edge_report(done, strategy.baseline_stride(spark, sf_dir)))


EDGE_SQL = recursive_sql(
    """SELECT instrument_id, baseline_n, round(baseline_mean, 8) AS baseline_mean, n, round(mean_return, 8) AS mean_return, round(positive_fraction, 8) AS positive_fraction, round(mean_return - baseline_mean, 8) AS excess,
  CASE WHEN n = 0 THEN 'NO_EVENTS' WHEN n < 10 THEN 'INSUFFICIENT_SAMPLE' WHEN mean_return > baseline_mean AND positive_fraction >= 0.5 THEN 'EXPLORATORY_POSITIVE' WHEN mean_return < baseline_mean AND positive_fraction < 0.5 THEN 'EXPLORATORY_NEGATIVE' ELSE 'MIXED' END AS evidence
FROM (SELECT instrument_id, baseline_n, baseline_mean, coalesce(n, 0) AS n, mean_return, positive_fraction
  FROM (SELECT r.instrument_id, count(*) AS baseline_n, avg(round(forward_return, 8)) AS baseline_mean FROM taken t JOIN ret r ON r.instrument_id = t.instrument_id AND r.signal_index = t.signal_index GROUP BY 1)
  FULL JOIN (SELECT instrument_id, count(*) AS n, avg(forward_return) AS mean_return, avg(CAST(forward_return > 0 AS DOUBLE)) AS positive_fraction FROM outs WHERE status = 'COMPLETE' AND horizon = 20 GROUP BY 1) USING (instrument_id))""",
    BASE, EV, path_ctes(), OUTCOMES,
    f"ret AS MATERIALIZED (SELECT instrument_id, signal_index, lead(close, 20) OVER ({P}) / lead(open, 1) OVER ({P}) - 1 AS forward_return FROM bars QUALIFY lead(close, 20) OVER ({P}) IS NOT NULL)",
    "taken AS (SELECT instrument_id, min(signal_index) AS signal_index FROM ret GROUP BY 1 UNION ALL SELECT t.instrument_id, (SELECT min(r.signal_index) FROM ret r WHERE r.instrument_id = t.instrument_id AND r.signal_index >= t.signal_index + 5) FROM taken t WHERE t.signal_index IS NOT NULL)",
)


def readable_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: breakouts 20 bars on against the thinned baseline, the timing null, the interval by months and the neighbours, and the verdict."""
    returns = research.breakout_returns(spark, sf_dir).where("horizon = 20")
    own = returns.agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean_return"))
    usual = strategy.baseline_stride(spark, sf_dir).agg(F.avg("forward_return").alias("baseline_mean"))
    timing = research.random_timing_null(spark, sf_dir).select("p_value", (F.col("observed") - F.col("null_mean")).alias("beyond_null"))
    interval = research.month_bootstrap_ci(spark, sf_dir).where("horizon = 20").select(F.col("low").alias("interval_low"))
    near = research.neighbour_readout(spark, sf_dir).where("duration = 20 and max_range_pct = 9").select("positive_fraction")
    key = F.lit(1).alias("one")  # single rows meet
    row = own.select("*", key)
    for part in (usual, timing, interval, near):
        row = row.join(part.select("*", key), "one", "left")
    row = row.withColumn("excess", F.col("mean_return") - F.col("baseline_mean"))
    return round_all(row.drop("one").withColumn("verdict", st.verdict(F.col("n"), F.col("excess"), F.col("p_value"), F.col("beyond_null"), F.col("interval_low"), F.col("positive_fraction"))))


def sample_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.sample_accounting(flawed_outcomes(spark, sf_dir))


ACCOUNTING_SQL = with_bars(
    "SELECT *, least(clusters, complete_events) AS effective_size FROM (SELECT horizon, count(*) AS raw_events, count(*) FILTER (status = 'COMPLETE') AS complete_events, count(DISTINCT instrument_id) AS instruments, count(DISTINCT strftime(signal_date, '%Y-%m')) FILTER (status = 'COMPLETE') AS clusters, count(*) FILTER (status <> 'COMPLETE') AS excluded FROM outs GROUP BY 1)",
    *FLAWED_OUTS,
)


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(rp.nearest_rank(flawed_outcomes(spark, sf_dir), ["horizon"], "forward_return", (0.025, 0.5, 0.975)))


RANK_SQL = with_bars(
    "SELECT horizon, p, round(v[1 + CAST(round_even((len(v) - 1) * p, 0) AS BIGINT)], 8) AS rounded, round(v[1 + CAST(floor((len(v) - 1) * p) AS BIGINT)], 8) AS floored FROM (SELECT horizon, list_sort(list(forward_return)) AS v FROM outs WHERE forward_return IS NOT NULL GROUP BY 1), (VALUES (0.025::DOUBLE), (0.5::DOUBLE), (0.975::DOUBLE)) q(p)",
    *FLAWED_OUTS,
)


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry derived from orders."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("experiment_id"), F.concat(F.lit("Study of customer "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("program"), F.to_date("o_orderdate").alias("created"))


REGISTRY = "registry AS (SELECT o_orderkey AS experiment_id, concat('Study of customer ', CAST(o_custkey AS VARCHAR)) AS title, o_orderstatus AS state, o_orderpriority AS program, CAST(o_orderdate AS DATE) AS created FROM orders)"


def experiment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = experiments(spark, sf_dir)
    programs = ("1-URGENT", "2-HIGH")
    return rp.filter_experiments(rows, state="F", programs=programs, since="1993-01-01", until="1998-12-31", text="CUSTOMER 1")


FILTER_SQL = f"WITH {REGISTRY} SELECT * FROM registry WHERE state = 'F' AND program IN ('1-URGENT', '2-HIGH') AND created BETWEEN DATE '1993-01-01' AND DATE '1998-12-31' AND contains(lower(title), 'customer 1')"


def experiment_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.facets(experiments(spark, sf_dir), ("state", "program"))


FACETS_SQL = f"WITH {REGISTRY} SELECT 'state' AS facet, state AS value, count(*) AS n FROM registry GROUP BY 2 UNION ALL SELECT 'program', program, count(*) FROM registry GROUP BY 2"

COHORT = ("I1", "I3", "I6")


def fixed_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a fixed list of instruments, and on how many of them each has a bar."""
    return rp.fixed_cohort(derive_bars(spark, sf_dir), COHORT).groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


COHORT_SQL = with_bars("SELECT instrument_id, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars WHERE instrument_id IN ('I1', 'I3', 'I6') GROUP BY 1")


def trend_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars above a rising 200-bar average, from the first that can be judged to the last but one of each instrument."""
    rows = pt.trend_candidates(derive_bars(spark, sf_dir), "ABOVE_RISING_SMA_200")
    return rows.select("instrument_id", "signal_index", "trade_date")


TREND_SQL = with_bars(
    f"""SELECT instrument_id, signal_index, trade_date FROM (SELECT *, lag(s200, 20) OVER ({P}) AS s_then, max(signal_index) OVER (PARTITION BY instrument_id) AS last_index
  FROM (SELECT *, {q_full('avg', 'close', 200)} AS s200 FROM bars)) WHERE close > s200 AND s200 > s_then AND signal_index < last_index"""
)


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash dividends derived from every 101st order; several of a day belong together."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 101 == 0)
    return orders.select(F.concat(F.lit("I"), (F.col("o_custkey") % 8).cast("string")).alias("instrument_id"), F.to_date("o_orderdate").alias("effective_date"), ((F.col("o_custkey") % 7) / F.lit(10.0)).alias("cash"))


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with split factor, dividends and adjusted prices."""
    got = ql.adjusted(derive_bars(spark, sf_dir), corporate_actions(spark, sf_dir), dividends(spark, sf_dir))
    return round_all(got.select("instrument_id", "trade_date", "split_factor", "dividend_cash", *[f"adjusted_{c}" for c in ("open", "high", "low", "close")]), 6)


ADJUSTED_SQL = with_bars(
    """SELECT b.instrument_id, b.trade_date, round(f, 6) AS split_factor, round(coalesce(cash, 0), 6) AS dividend_cash, round(open * f, 6) AS adjusted_open, round(high * f, 6) AS adjusted_high, round(low * f, 6) AS adjusted_low, round(close * f, 6) AS adjusted_close
FROM (SELECT b.*, pow(0.5::DOUBLE, (SELECT count(*) FROM actions a WHERE a.instrument_id = b.instrument_id AND a.effective_date > b.trade_date)) AS f FROM bars b) b
LEFT JOIN (SELECT concat('I', CAST(o_custkey % 8 AS VARCHAR)) AS instrument_id, CAST(o_orderdate AS DATE) AS trade_date, sum((o_custkey % 7) / 10.0::DOUBLE) AS cash FROM orders WHERE o_orderkey % 101 = 0 GROUP BY 1, 2) d ON d.instrument_id = b.instrument_id AND d.trade_date = b.trade_date""",
    ACTIONS_CTE,
)


def quality_issues_nine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine rules: split factors of zero and negative dividends beside the damaged prices."""
    k = F.col("signal_index")
    bars = data.damaged(spark, sf_dir).withColumn("split_factor", F.when(k % 127 == 0, F.lit(0.0)).otherwise(1.0)).withColumn("dividend_cash", F.when(k % 131 == 0, F.lit(-0.5)).otherwise(0.0))
    return ql.issues(bars)


NINE_SQL = with_bars(
    """SELECT instrument_id, trade_date, issue, status FROM issues
UNION ALL SELECT instrument_id, trade_date, 'INVALID_SPLIT_FACTOR', 'QUARANTINE' FROM damaged WHERE close IS NOT NULL AND signal_index % 127 = 0
UNION ALL SELECT instrument_id, trade_date, 'NEGATIVE_DIVIDEND', 'QUARANTINE' FROM damaged WHERE close IS NOT NULL AND signal_index % 131 = 0""",
    data.DAMAGED,
    data.ISSUES,
)


def symbol_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a history derived from orders: each order's customer holds a symbol for the days that its number says."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 == 0)
    start = F.to_date("o_orderdate")
    history = orders.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("instrument_id"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("symbol"), start.alias("effective_from"), F.when(F.col("o_orderkey") % 35 != 0, F.date_add(start, (F.col("o_orderkey") % 400).cast("int"))).alias("effective_to"))
    return ql.history_overlaps(history)


OVERLAPS_SQL = """SELECT instrument_id, symbol, effective_from, effective_to, held_until FROM (
  SELECT *, max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY instrument_id ORDER BY effective_from, coalesce(effective_to, DATE '9999-12-31'), symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_until
  FROM (SELECT DISTINCT concat('C', CAST(o_custkey AS VARCHAR)) AS instrument_id, concat('S', CAST(o_orderkey AS VARCHAR)) AS symbol, CAST(o_orderdate AS DATE) AS effective_from,
      CASE WHEN o_orderkey % 35 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS effective_to FROM orders WHERE o_orderkey % 5 = 0))
WHERE effective_from <= held_until"""


def provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one provider against the origins of the other, of which some days are left out."""
    bars = derive_bars(spark, sf_dir)
    other = second_provider(bars)
    return ql.provenance_gaps(bars.where(F.dayofyear("trade_date") % 19 != 0), other.withColumn("included", F.dayofyear("trade_date") % 13 != 0))


GAPS_SQL = with_bars(
    """SELECT instrument_id, count(*) FILTER (origin IS NULL) AS without_origin, count(*) FILTER (bar IS NULL) AS without_bar, count(*) FILTER (bar IS NOT NULL AND origin IS NOT NULL) AS matched
FROM (SELECT instrument_id, trade_date, 1 AS bar FROM bars WHERE dayofyear(trade_date) % 19 <> 0)
FULL JOIN (SELECT instrument_id, trade_date, 1 AS origin FROM bars WHERE dayofyear(trade_date) % 23 <> 0 AND dayofyear(trade_date) % 13 <> 0) USING (instrument_id, trade_date) GROUP BY 1"""
)

QUERIES = {
    "symbol_overlaps": (symbol_overlaps, OVERLAPS_SQL),
    "provenance_gaps": (provenance_gaps, GAPS_SQL),
    "edge_report": (edge_report, EDGE_SQL),
    "readable_edge": (readable_edge, None),
    "sample_accounting": (sample_accounting, ACCOUNTING_SQL),
    "nearest_rank_quantiles": (nearest_rank, RANK_SQL),
    "experiment_filter": (experiment_filter, FILTER_SQL),
    "experiment_facets": (experiment_facets, FACETS_SQL),
    "fixed_cohort": (fixed_cohort, COHORT_SQL),
    "trend_candidates": (trend_candidates, TREND_SQL),
    "adjusted_bars": (adjusted_bars, ADJUSTED_SQL),
    "quality_issues_nine": (quality_issues_nine, NINE_SQL),
}
