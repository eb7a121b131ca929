"""Queries of the statistics, sweeps and experiment records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.indicators import full

from tidemark.operators import outcomes as oc
from tidemark.operators import patterns as pt
from tidemark.operators import statistics as st
from tidemark.plans.features import recursive_sql
from tidemark.plans.strategy import BASE, EV, OUTCOMES, PATH, raw_breakouts, round_all
from tidemark.session import shared_path
from tidemark.sources.bars import derive_bars, table, with_bars

#: Cells of the surface: sessions of a base, and its range in per cent of its low; events rest for so many sessions.
DURATIONS, RANGES, COOLDOWN = (10, 20, 30, 40, 60), (6, 9, 12, 15, 18), 5


def breakout_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, bars = raw_breakouts(spark, sf_dir)
    return oc.outcome_paths(events, bars, (5, 20)).where("status = 'COMPLETE'")


def staged_returns(spark: SparkSession, sf_dir: str, horizons: Sequence[int]) -> DataFrame:
    """The complete returns of breakouts, written once for the several statistics that read them."""
    events, bars = raw_breakouts(spark, sf_dir)
    path = shared_path(spark, "returns")
    oc.outcome_paths(events, bars, tuple(horizons)).where("status = 'COMPLETE'").write.parquet(path)
    return spark.read.parquet(path)


DONE = "done AS (SELECT *, forward_return AS x, strftime(signal_date, '%Y-%m') AS month FROM outs WHERE status = 'COMPLETE')"
#: Rounds of the month bootstrap, of random timing and of the sign flips.
BOOTSTRAPS, TIMINGS, FLIPS = 2_000, 1_000, 10_000
CTES = (BASE, EV, PATH, OUTCOMES, DONE)


def performance_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.readout(breakout_returns(spark, sf_dir), ["horizon"]))


READOUT_SQL = with_bars(
    """SELECT horizon, n, round(mean, 8) AS mean, round(median, 8) AS median, round(sd, 8) AS sd, round(win_rate, 8) AS win_rate, round(average_win, 8) AS average_win, round(average_loss, 8) AS average_loss, round(payoff, 8) AS payoff,
  round(profit_factor, 8) AS profit_factor, round(least, 8) AS least, round(p05, 8) AS p05, round(p25, 8) AS p25, round(p75, 8) AS p75, round(p95, 8) AS p95, round(most, 8) AS most, round(skew, 8) AS skew, round(excess_kurtosis, 8) AS excess_kurtosis, round(top5_profit_share, 8) AS top5_profit_share
FROM (SELECT d.horizon, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS sd, avg(CAST(x > 0 AS DOUBLE)) AS win_rate, avg(x) FILTER (x > 0) AS average_win, avg(x) FILTER (x < 0) AS average_loss,
  avg(x) FILTER (x > 0) / -avg(x) FILTER (x < 0) AS payoff, sum(x) FILTER (x > 0) / -sum(x) FILTER (x < 0) AS profit_factor, min(x) AS least, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75,
  quantile_cont(x, 0.95) AS p95, max(x) AS most, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS skew, avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 AS excess_kurtosis,
  list_sum(list_reverse_sort(list(x) FILTER (x > 0))[1:5]) / sum(x) FILTER (x > 0) AS top5_profit_share
  FROM done d JOIN (SELECT horizon, avg(x) AS m FROM done GROUP BY 1) a ON a.horizon = d.horizon GROUP BY 1)""",
    *CTES,
)


def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = breakout_returns(spark, sf_dir).groupBy("instrument_id", "horizon").agg(F.count("*").alias("n"), F.count_if(F.col("forward_return") > 0).alias("wins"))
    low, high = st.wilson(F.col("wins").cast("double"), F.col("n").cast("double"))
    return round_all(got.select("instrument_id", "horizon", "n", "wins", low.alias("low"), high.alias("high")))


WILSON_SQL = with_bars(
    f"""SELECT instrument_id, horizon, n, wins, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 0), 8) AS low,
  round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 1), 8) AS high
FROM (SELECT instrument_id, horizon, count(*) AS n, count(*) FILTER (x > 0) AS wins, count(*) FILTER (x > 0) / CAST(count(*) AS DOUBLE) AS p, {st.Z95}::DOUBLE AS z FROM done GROUP BY 1, 2)""",
    *CTES,
)


def monthly_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and instruments by month, months without an event included."""
    events, bars = raw_breakouts(spark, sf_dir)
    span = bars.agg(F.trunc(F.min("trade_date"), "month").alias("a"), F.trunc(F.max("trade_date"), "month").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    hits = st.months(events, "trade_date").groupBy("month").agg(F.count("*").alias("events"), F.countDistinct("instrument_id").alias("instruments"))
    return every.join(hits, "month", "left").select("month", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("instruments", F.lit(0)).alias("instruments"))


MONTHLY_SQL = with_bars(
    """SELECT m.month, coalesce(events, 0) AS events, coalesce(instruments, 0) AS instruments
FROM (SELECT strftime(d, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(trade_date)), date_trunc('month', max(trade_date)), INTERVAL 1 MONTH)) AS d FROM bars)) m
LEFT JOIN (SELECT strftime(trade_date, '%Y-%m') AS month, count(*) AS events, count(DISTINCT instrument_id) AS instruments FROM ev GROUP BY 1) h ON h.month = m.month""",
    BASE,
    EV,
)


def instrument_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = breakout_returns(spark, sf_dir).where("horizon = 20").groupBy("instrument_id").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean_return"), F.percentile("forward_return", 0.5).alias("median_return"), F.min("signal_date").alias("first_signal"), F.max("signal_date").alias("last_signal"))
    return round_all(got)


INSTRUMENT_SQL = with_bars("SELECT instrument_id, count(*) AS n, round(avg(x), 8) AS mean_return, round(quantile_cont(x, 0.5), 8) AS median_return, min(signal_date) AS first_signal, max(signal_date) AS last_signal FROM done WHERE horizon = 20 GROUP BY 1", *CTES)


def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of instruments with events, share of the five busiest, share of active months."""
    events, bars = raw_breakouts(spark, sf_dir)
    per = events.groupBy("instrument_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "instrument_id")
    top = per.limit(5).agg(F.sum("n").alias("top5"))
    total = per.agg(F.sum("n").alias("events"), F.count("*").alias("with_events"))
    span = bars.agg(F.countDistinct("instrument_id").alias("instruments"), (F.months_between(F.trunc(F.max("trade_date"), "month"), F.trunc(F.min("trade_date"), "month")) + 1).alias("months"))
    active = st.months(events, "trade_date").agg(F.countDistinct("month").alias("active"))
    row = total.withColumn("one", F.lit(1))
    for other in (top, span, active):
        row = row.join(F.broadcast(other.withColumn("one", F.lit(1))), "one")
    return round_all(row.select("events", (F.col("with_events") / F.col("instruments")).alias("breadth"), (F.col("top5") / F.col("events")).alias("top5_share"), (F.col("active") / F.col("months")).alias("active_month_fraction")))


BREADTH_SQL = with_bars(
    """SELECT count(*) AS events, round(count(DISTINCT instrument_id) / CAST((SELECT count(DISTINCT instrument_id) FROM bars) AS DOUBLE), 8) AS breadth,
  round((SELECT sum(n) FROM (SELECT count(*) AS n FROM ev GROUP BY instrument_id ORDER BY n DESC, instrument_id LIMIT 5)) / CAST(count(*) AS DOUBLE), 8) AS top5_share,
  round(count(DISTINCT strftime(trade_date, '%Y-%m')) / CAST((SELECT datediff('month', min(trade_date), max(trade_date)) + 1 FROM bars) AS DOUBLE), 8) AS active_month_fraction FROM ev""",
    BASE,
    EV,
)


def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level aggregate: every instrument weighs the same."""
    per = breakout_returns(spark, sf_dir).groupBy("instrument_id", "horizon").agg(F.avg("forward_return").alias("m"), F.percentile("forward_return", 0.5).alias("d"))
    return round_all(per.groupBy("horizon").agg(F.count("*").alias("instruments"), F.avg("m").alias("mean_of_means"), F.percentile("d", 0.5).alias("median_of_medians")))


MEANS_SQL = with_bars("SELECT horizon, count(*) AS instruments, round(avg(m), 8) AS mean_of_means, round(quantile_cont(d, 0.5), 8) AS median_of_medians FROM (SELECT instrument_id, horizon, avg(x) AS m, quantile_cont(x, 0.5) AS d FROM done GROUP BY 1, 2) GROUP BY 1", *CTES)


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = breakout_returns(spark, sf_dir).groupBy("horizon").agg(F.avg("forward_return").alias("mean"))
    cost = F.explode(F.array(*[F.lit(c) for c in (0, 5, 10, 25, 50, 100)])).alias("bps")
    return round_all(mean.select("horizon", cost, "mean").select("horizon", "bps", (F.col("mean") - F.col("bps") / 1e4).alias("net_mean"), F.when(F.col("mean") > 0, F.col("mean") * 1e4).alias("break_even_bps")))


COST_SQL = with_bars("SELECT horizon, bps, round(m - bps / 1e4, 8) AS net_mean, round(CASE WHEN m > 0 THEN m * 1e4 END, 8) AS break_even_bps FROM (SELECT horizon, avg(x) AS m FROM done GROUP BY 1), (VALUES (0), (5), (10), (25), (50), (100)) c(bps)", *CTES)


def surface_of(bars: DataFrame, durations: Sequence[int] = DURATIONS, ranges: Sequence[int] = RANGES, cooldown: int = COOLDOWN, horizon: int = 20, gap: int = 5) -> DataFrame:
    """Every cell of duration x tightness: events after the cooldown, their instruments, their return ``horizon`` bars on and its excess over the thinned baseline.

    One pass over bars with the frames of all durations; only closes above some base go on, one row for each cell that they qualify for.
    """
    w = pt.by_window()
    rows = bars.withColumn("ret", F.lead("close", horizon).over(w) / F.lead("open", 1).over(w) - 1)
    for d in durations:
        rows = rows.withColumn(f"h{d}", full(F.max, F.col("hc"), d, -1)).withColumn(f"l{d}", full(F.min, F.col("lc"), d, -1))
    cell = lambda d, r: F.when((F.col("cc") > F.col(f"h{d}")) & ((F.col(f"h{d}") - F.col(f"l{d}")) * 100 <= r * F.col(f"l{d}")), F.struct(F.lit(d).alias("duration"), F.lit(r).alias("max_range_pct")))
    hits = rows.select("instrument_id", "signal_index", "ret", F.explode(F.array_compact(F.array(*[cell(d, r) for d in durations for r in ranges]))).alias("c")).select("instrument_id", "signal_index", "ret", "c.*")
    events = oc.stride(hits, cooldown, strict=True, by=("instrument_id", "duration", "max_range_pct"))
    usual = oc.baseline(bars, bars.select("instrument_id", "signal_index"), (horizon,), gap, "path").agg(F.avg("forward_return").alias("baseline_mean"))
    got = events.groupBy("duration", "max_range_pct").agg(F.count("*").alias("events"), F.count_distinct("instrument_id").alias("instruments"), F.count("ret").alias("complete"), F.avg("ret").alias("mean_return"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_fraction"))
    return got.crossJoin(F.broadcast(usual)).withColumn("excess", F.col("mean_return") - F.col("baseline_mean"))  # the baseline is one row


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(surface_of(derive_bars(spark, sf_dir)))


def _surface_sql(body: str, *ctes: str) -> str:
    hits = " UNION ALL ".join(
        f"SELECT instrument_id, signal_index, ret, {d} AS duration, r AS max_range_pct FROM (SELECT *, max(hc) OVER w{d} AS hm, min(lc) OVER w{d} AS lm FROM rets WINDOW w{d} AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN {d} PRECEDING AND 1 PRECEDING)), (VALUES {', '.join(f'({r})' for r in RANGES)}) v(r) WHERE signal_index >= {d} AND cc > hm AND (hm - lm) * 100 <= r * lm"
        for d in DURATIONS
    )
    greedy = lambda source, key, least: f"SELECT {key}, min(signal_index) AS signal_index FROM {source} GROUP BY ALL UNION ALL SELECT {', '.join('t.' + k for k in key.split(', '))}, (SELECT min(r.signal_index) FROM {source} r WHERE {' AND '.join(f'r.{k} = t.{k}' for k in key.split(', '))} AND r.signal_index >= t.signal_index + {least}) FROM {source}_taken t WHERE t.signal_index IS NOT NULL"
    key = "instrument_id, duration, max_range_pct"
    return recursive_sql(
        body,
        "rets AS MATERIALIZED (SELECT *, lead(close, 20) OVER w / lead(open, 1) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date))",
        f"hits AS MATERIALIZED ({hits})",
        f"hits_taken AS ({greedy('hits', key, COOLDOWN + 1)})",
        "usable AS MATERIALIZED (SELECT * FROM rets WHERE ret IS NOT NULL)",
        f"usable_taken AS ({greedy('usable', 'instrument_id', 5)})",
        "usual AS MATERIALIZED (SELECT avg(ret) AS baseline_mean FROM usable_taken JOIN usable USING (instrument_id, signal_index))",
        f"""cells AS MATERIALIZED (SELECT *, mean_return - baseline_mean AS excess FROM (
  SELECT duration, max_range_pct, count(*) AS events, count(DISTINCT instrument_id) AS instruments, count(ret) AS complete, avg(ret) AS mean_return, avg(CAST(ret > 0 AS DOUBLE)) AS positive_fraction FROM hits_taken JOIN hits USING ({key}, signal_index) GROUP BY 1, 2), usual)""",
        *ctes,
    )


SURFACE_SQL = _surface_sql("SELECT duration, max_range_pct, events, instruments, complete, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("mean_return", "positive_fraction", "baseline_mean", "excess")) + " FROM cells")


def surface_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface read along each axis at every value of the other one."""
    cells = surface(spark, sf_dir)
    along = lambda axis, other: cells.select(F.lit(axis).alias("axis"), F.col(other).cast("double").alias("fixed"), F.col(axis).cast("double").alias("value"), "mean_return")
    points = along("duration", "max_range_pct").unionByName(along("max_range_pct", "duration"))
    return round_all(st.response_shape(points, ["axis", "fixed"], "value", "mean_return"))


READING_SQL = _surface_sql(
    """SELECT axis, fixed, cells, shape, CASE WHEN cells > 2 THEN v END AS best_value, CASE WHEN cells > 2 THEN round(e, 8) END AS best_expectancy, CASE WHEN cells > 2 THEN plateau_low END AS plateau_low, CASE WHEN cells > 2 THEN plateau_high END AS plateau_high,
  CASE WHEN cells > 2 THEN plateau_cells END AS plateau_cells,
  CASE WHEN cells > 2 THEN round(CASE WHEN shape = 'increasing' AND v = last THEN last WHEN shape = 'decreasing' AND v = first THEN greatest(0, first - reach) ELSE below END, 8) END AS next_low,
  CASE WHEN cells > 2 THEN round(CASE WHEN shape = 'increasing' AND v = last THEN last + reach WHEN shape = 'decreasing' AND v = first THEN first ELSE above END, 8) END AS next_high
FROM (SELECT *, greatest(last - first, 5 * step) AS reach, CASE WHEN cells < 3 THEN 'insufficient' WHEN rising >= greatest(1, (4 * (cells - 1) + 4) // 5) AND e1 > e0 + flat THEN 'increasing' WHEN falling >= greatest(1, (4 * (cells - 1) + 4) // 5) AND e1 < e0 - flat THEN 'decreasing' ELSE 'mixed' END AS shape FROM told)""",
    """points AS (SELECT 'duration' AS axis, CAST(max_range_pct AS DOUBLE) AS fixed, CAST(duration AS DOUBLE) AS v, round(mean_return, 8) AS e FROM cells WHERE mean_return IS NOT NULL
  UNION ALL SELECT 'max_range_pct', CAST(duration AS DOUBLE), CAST(max_range_pct AS DOUBLE), round(mean_return, 8) FROM cells WHERE mean_return IS NOT NULL)""",
    """steps AS (SELECT *, e - lag(e) OVER o AS diff, v - lag(v) OVER o AS gap, coalesce(lag(v) OVER o, v) AS below, coalesce(lead(v) OVER o, v) AS above, greatest(1e-12, 0.08 * (max(e) OVER p - min(e) OVER p)) AS flat,
  e >= max(e) OVER p - greatest(0.005, 0.12 * (max(e) OVER p - min(e) OVER p)) AS near, row_number() OVER (PARTITION BY axis, fixed ORDER BY e DESC, v) = 1 AS top FROM points WINDOW o AS (PARTITION BY axis, fixed ORDER BY v), p AS (PARTITION BY axis, fixed))""",
    "islands AS (SELECT *, max(CASE WHEN top THEN island END) OVER (PARTITION BY axis, fixed) AS home FROM (SELECT *, sum(CAST(NOT near AS INT)) OVER (PARTITION BY axis, fixed ORDER BY v) AS island FROM steps))",
    """told AS (SELECT axis, fixed, count(*) AS cells, count(*) FILTER (diff >= -flat) AS rising, count(*) FILTER (diff <= flat) AS falling, arg_min(e, v) AS e0, arg_max(e, v) AS e1, max(flat) AS flat, min(v) AS first, max(v) AS last, quantile_cont(gap, 0.5) AS step,
  max(v) FILTER (top) AS v_top, max(e) FILTER (top) AS e, max(below) FILTER (top) AS below, max(above) FILTER (top) AS above, min(v) FILTER (near AND island = home) AS plateau_low, max(v) FILTER (near AND island = home) AS plateau_high, count(*) FILTER (near AND island = home) AS plateau_cells
  FROM islands GROUP BY 1, 2)""",
).replace("THEN v END AS best_value", "THEN v_top END AS best_value").replace("AND v = last", "AND v_top = last").replace("AND v = first", "AND v_top = first")


def neighbour_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_all(st.neighbourhood(surface(spark, sf_dir), ["duration", "max_range_pct"], "mean_return"))


NEIGHBOUR_SQL = _surface_sql(
    """SELECT a.duration, a.max_range_pct, count(b.mean_return) AS neighbours, round(avg(CAST(b.mean_return > 0 AS DOUBLE)), 8) AS positive_fraction, round(max(b.mean_return), 8) AS best_neighbour
FROM (SELECT *, dense_rank() OVER (ORDER BY duration) AS i, dense_rank() OVER (ORDER BY max_range_pct) AS j FROM cells) a
JOIN (SELECT *, dense_rank() OVER (ORDER BY duration) AS i, dense_rank() OVER (ORDER BY max_range_pct) AS j FROM cells) b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY 1, 2"""
)


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hypothesis, p): a p-like number per instrument, from its win rate."""
    got = breakout_returns(spark, sf_dir).groupBy("instrument_id", "horizon").agg(F.avg((F.col("forward_return") <= 0).cast("double")).alias("p"))
    return got.select(F.concat_ws("/", "instrument_id", F.col("horizon").cast("string")).alias("hypothesis"), F.round(F.col("p") * F.col("p") * F.col("p"), 8).alias("p"))


def adjust(method: str):
    return lambda spark, sf_dir: round_all(st.adjusted(_tests(spark, sf_dir), method))


TESTS = "tests AS MATERIALIZED (SELECT concat(instrument_id, '/', CAST(horizon AS VARCHAR)) AS hypothesis, round(p * p * p, 8) AS p FROM (SELECT instrument_id, horizon, avg(CAST(x <= 0 AS DOUBLE)) AS p FROM done GROUP BY 1, 2))"
BH_SQL = with_bars("SELECT hypothesis, p, round(least(1, min(raw) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS p_adjusted FROM (SELECT *, p * count(*) OVER () / rank AS raw FROM (SELECT *, row_number() OVER (ORDER BY p, hypothesis) AS rank FROM tests))", *CTES, TESTS)
BONFERRONI_SQL = with_bars("SELECT hypothesis, p, round(least(1, p * count(*) OVER ()), 8) AS p_adjusted FROM tests", *CTES, TESTS)

def fold_outcomes(spark: SparkSession, outcomes: DataFrame, folds: list[tuple[int, str, str, str, str]]) -> DataFrame:
    """Outcomes of each expanding fold: training and test events, and the test mean."""
    folds = spark.createDataFrame(folds, "fold int, train_start string, train_end string, test_start string, test_end string")
    rows = outcomes.withColumn("one", F.lit(1)).join(F.broadcast(folds.withColumn("one", F.lit(1))), "one")
    d = F.col("signal_date")
    train, test = (d >= F.to_date("train_start")) & (d < F.to_date("train_end")), (d >= F.to_date("test_start")) & (d < F.to_date("test_end"))
    return round_all(rows.groupBy("fold").agg(F.count_if(train).alias("train_n"), F.count_if(test).alias("test_n"), F.avg(F.when(test, F.col("forward_return"))).alias("test_mean")))


def walk_forward_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold for each year of outcomes after the first one, up to the last."""
    outcomes = breakout_returns(spark, sf_dir).where("horizon = 20")
    first, last = outcomes.agg(F.min(F.year("signal_date")), F.max(F.year("signal_date"))).first()
    years = [] if first is None else [f"{y:04d}-01-01" for y in range(first, last + 2)]
    return fold_outcomes(spark, outcomes, st.walk_forward(years) if len(years) > 2 else [])


SPAN_FOLDS_SQL = with_bars(
    """SELECT fold, count(*) FILTER (signal_date >= a AND signal_date < b) AS train_n, count(*) FILTER (signal_date >= b AND signal_date < c) AS test_n, round(avg(x) FILTER (signal_date >= b AND signal_date < c), 8) AS test_mean
FROM done, (SELECT y - lo AS fold, make_date(lo, 1, 1) AS a, make_date(y, 1, 1) AS b, make_date(y + 1, 1, 1) AS c FROM (SELECT lo, unnest(generate_series(lo + 1, hi)) AS y FROM (SELECT min(year(signal_date)) AS lo, max(year(signal_date)) AS hi FROM done WHERE horizon = 20))) WHERE horizon = 20 GROUP BY 1""",
    *CTES,
)


def _monthly(df: DataFrame) -> DataFrame:
    return st.months(df, "signal_date").groupBy("month").agg(F.sum("forward_return").alias("total"), F.count("*").alias("n"))


def month_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = breakout_returns(spark, sf_dir)
    monthly = st.months(rows, "signal_date").groupBy("horizon", "month").agg(F.sum("forward_return").alias("total"), F.count("*").alias("n"))
    return round_all(st.month_bootstrap(monthly, BOOTSTRAPS, 20260817, ["horizon"]))


def paired_month_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = breakout_returns(spark, sf_dir)
    return round_all(st.paired_month_bootstrap(_monthly(rows.where("horizon = 20")), _monthly(rows.where("horizon = 5")), BOOTSTRAPS, 7))


def every_timing(spark: SparkSession, sf_dir: str, horizon: int = 20) -> DataFrame:
    """The return of every bar with a whole path: the pool that random timing draws from."""
    bars = derive_bars(spark, sf_dir)
    return oc.baseline(bars, bars.select("instrument_id", "signal_index"), (horizon,), 1, "path")


def random_timing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = breakout_returns(spark, sf_dir).where("horizon = 20").select("instrument_id", "signal_index", "forward_return")
    return round_all(st.random_timing(events, every_timing(spark, sf_dir), TIMINGS, 20260818))


def sign_flip_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = _monthly(breakout_returns(spark, sf_dir).where("horizon = 20")).select("month", (F.col("total") / F.col("n")).alias("gap"))
    return round_all(st.sign_flip(monthly, FLIPS, 3))


def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration row for every instrument of the data and every combination of three short axes."""
    axis = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    grid = derive_bars(spark, sf_dir).select("instrument_id").distinct().select("instrument_id", axis("duration", (10, 20, 30))).select("*", axis("max_range_pct", (6, 9))).select("*", axis("horizon", (5, 20)))
    return grid.withColumn("config", F.concat_ws("/", *[F.col(c).cast("string") for c in ("instrument_id", "duration", "max_range_pct", "horizon")]))


GRID_SQL = with_bars("SELECT instrument_id, d AS duration, r AS max_range_pct, h AS horizon, concat(instrument_id, '/', d, '/', r, '/', h) AS config FROM (SELECT DISTINCT instrument_id FROM bars), (VALUES (10), (20), (30)) a(d), (VALUES (6), (9)) b(r), (VALUES (5), (20)) c(h)")


#: Doublings of the links: a round of :func:`ancestors` climbs two to the power of so many levels.
JUMPS = 2


def ancestors(links: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of all ancestors of ``links`` (id, parent), some levels a round; a cycle fails.

    Links are doubled to paths of four levels first. A round is written, and its ends are joined to the paths once for the next
    one, until none is left, so ids and links are shuffled once for four levels and not for each. Every row of a cycle meets itself
    on its way up, so a cycle of any length is found by the round that reaches its length. No depth is cut off.
    """
    spark, path = links.sparkSession, shared_path(links.sparkSession, "ancestors")
    links.where("parent is not null").select("id", "parent").distinct().write.parquet(f"{path}/links")
    up = spark.read.parquet(f"{path}/links")
    several = up.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if several:
        raise ValueError(f"{several[0].id} has several parents")
    paths, width = up.select("id", F.array("parent").alias("path")), 1
    for n in range(JUMPS):
        whole = F.size("path") == width
        further = paths.select(F.col("id").alias("end"), F.col("path").alias("more"))
        longer = paths.where(whole).withColumn("end", F.col("path")[width - 1]).join(further, "end", "left").select("id", F.concat("path", F.coalesce("more", F.slice("path", 1, 0))).alias("path"))
        longer.unionByName(paths.where(~whole)).write.parquet(f"{path}/paths-{n}")
        paths, width = spark.read.parquet(f"{path}/paths-{n}"), 2 * width
    level, depth = paths, 0
    while True:
        rows = level.select("id", F.posexplode("path").alias("_pos", "ancestor"))
        rows.select("id", "ancestor", (F.col("_pos") + F.lit(depth + 1)).alias("depth")).write.parquet(f"{path}/levels/{depth:06d}")
        depth += width
        level = spark.read.parquet(f"{path}/levels/{depth - width:06d}")
        found = level.agg(F.count_if(F.col("depth") == depth).alias("n"), F.min(F.when(F.col("id") == F.col("ancestor"), F.col("id"))).alias("own")).first()
        if found.own is not None:
            raise ValueError(f"{found.own} is its own ancestor")
        if not found.n:
            return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/levels")
        level = level.where(F.col("depth") == depth).select("id", F.col("ancestor").alias("end")).join(paths.withColumnRenamed("id", "end"), "end").select("id", "path")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every experiment, with depth."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return ancestors(orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") >= 2, F.floor(F.col("o_orderkey") / 2)).alias("parent")))


LINEAGE_SQL = "WITH RECURSIVE links AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_orderkey >= 2 THEN o_orderkey // 2 END AS parent FROM orders), up AS (SELECT id, parent AS ancestor, 1 AS depth FROM links WHERE parent IS NOT NULL UNION ALL SELECT up.id, l.parent, up.depth + 1 FROM up JOIN links l ON l.id = up.ancestor WHERE l.parent IS NOT NULL) SELECT id, ancestor, depth FROM up"


QUERIES = {
    "performance_readout": (performance_readout, READOUT_SQL),
    "wilson_interval": (wilson_interval, WILSON_SQL),
    "monthly_hits": (monthly_hits, MONTHLY_SQL),
    "instrument_summaries": (instrument_summaries, INSTRUMENT_SQL),
    "breadth": (breadth, BREADTH_SQL),
    "batch_mean_of_means": (mean_of_means, MEANS_SQL),
    "cost_sensitivity": (cost_sensitivity, COST_SQL),
    "parameter_surface": (surface, SURFACE_SQL),
    "surface_reading": (surface_reading, READING_SQL),
    "neighbour_readout": (neighbour_readout, NEIGHBOUR_SQL),
    "bh_adjust": (adjust("benjamini_hochberg"), BH_SQL),
    "bonferroni_adjust": (adjust("bonferroni"), BONFERRONI_SQL),
    "walk_forward_folds": (walk_forward_span, SPAN_FOLDS_SQL),
    "walk_forward_span": (walk_forward_span, SPAN_FOLDS_SQL),
    "month_bootstrap_ci": (month_bootstrap_ci, None),
    "paired_month_ci": (paired_month_ci, None),
    "random_timing_null": (random_timing_null, None),
    "sign_flip_p": (sign_flip_p, None),
    "grid_expand": (grid_expand, GRID_SQL),
    "experiment_lineage": (lineage, LINEAGE_SQL),
}
