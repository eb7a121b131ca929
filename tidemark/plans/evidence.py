"""Queries of stores, normalisation, evidence and edge families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import evidence as ev
from tidemark.operators import patterns as pt
from tidemark.operators import quality as ql
from tidemark.operators import risk
from tidemark.operators import statistics as st
from tidemark.plans.data import DAMAGED, SECOND, damaged
from tidemark.plans.features import TR, q_full
from tidemark.plans.research import BOOTSTRAPS, FLIPS, breakout_returns, staged_returns
from tidemark.plans.strategy import BASE, EV, market_benchmark, raw_breakouts, round_all
from tidemark.session import shared_path
from tidemark.sources import backfill as bf
from tidemark.sources import bars as src
from tidemark.sources.bars import ACTIONS_CTE, INSTRUMENTS_CTE, derive_bars, with_bars
from tidemark.sources.store import Store


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical bars promoted, promoted again unchanged, and loaded with verification."""
    store = Store(spark, shared_path(spark, "canonical"))
    bars = src.canonical(derive_bars(spark, sf_dir)).drop("dataset_version")
    store.promote(bars, "v1")
    store.promote(bars, "v1")
    return round_all(store.load("v1").groupBy("instrument_id").agg(F.count("*").alias("n"), F.max("close_raw").alias("max_close"), F.min("trade_date").alias("first_date")))


STORE_SQL = with_bars("SELECT instrument_id, count(*) AS n, round(max(close), 8) AS max_close, min(trade_date) AS first_date FROM bars GROUP BY 1")


def normalise_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider rows with planted holes: rows by issue, and the bars that remain."""
    d = derive_bars(spark, sf_dir)
    k = F.col("signal_index")
    hole = lambda n, x: F.when(k % n != 0, x)
    rows = d.select(F.lit("synthetic").alias("provider_id"), F.col("instrument_id").alias("provider_instrument_id"), "trade_date", hole(31, F.lit(1.0)).alias("split_factor"), hole(37, F.lit(0.0)).alias("dividend_cash"), F.col("open").alias("adjusted_open"), F.col("high").alias("adjusted_high"), F.col("low").alias("adjusted_low"), hole(41, F.col("close")).alias("adjusted_close"))
    master = src.instruments(spark, sf_dir).where("instrument_id <> 'I6'").select(F.lit("synthetic").alias("provider_id"), F.col("instrument_id").alias("provider_instrument_id"), "instrument_id")
    good, bad = ev.normalise(rows, master)
    counts = bad.groupBy("provider_instrument_id", "issue").agg(F.count("*").alias("n"))
    return counts.unionByName(good.groupBy("provider_instrument_id").agg(F.count("*").alias("n")).withColumn("issue", F.lit("NONE")))


NORMALISE_SQL = with_bars(
    "SELECT instrument_id AS provider_instrument_id, CASE WHEN instrument_id = 'I6' THEN 'UNRESOLVED_INSTRUMENT' WHEN signal_index % 31 = 0 THEN 'MISSING_SPLIT_FACTOR' WHEN signal_index % 37 = 0 THEN 'MISSING_DIVIDEND' WHEN signal_index % 41 = 0 THEN 'PARTIAL_ADJUSTED_PRICES' ELSE 'NONE' END AS issue, count(*) AS n FROM bars GROUP BY 1, 2"
)


def coverage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coverage_checks(derive_bars(spark, sf_dir), "1992-01-01", "1998-12-31", 500, 60)


COVERAGE_SQL = with_bars(
    "SELECT *, observations >= 500 AND start_lag <= 60 AND end_lag <= 60 AS passed FROM (SELECT instrument_id, count(*) AS observations, datediff('day', DATE '1992-01-01', min(trade_date)) AS start_lag, datediff('day', max(trade_date), DATE '1998-12-31') AS end_lag FROM bars GROUP BY 1)"
)


def coverage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge class of each instrument: the gap is March 1996 in A, the anchor the first session after it."""
    d = derive_bars(spark, sf_dir)
    a = d.where((F.date_format("trade_date", "yyyy-MM") != "1996-03") | (F.col("instrument_id") == "I1"))
    found = ql.evidence(a, src.second_provider(d)).select("instrument_id", "trade_date", "state")
    gap, later = F.date_format("trade_date", "yyyy-MM") == "1996-03", F.col("trade_date") >= F.lit("1996-04-01").cast("date")
    got = found.groupBy("instrument_id").agg(
        F.count_if(gap & F.col("state").isin("A_ONLY", "BOTH_AGREE", "BOTH_DISAGREE")).alias("in_a"), F.count_if(gap & (F.col("state") != "B_ONLY")).alias("other"),
        F.min_by(F.when(later, F.col("state")), F.when(later, F.col("trade_date"))).alias("anchor"),
    )
    return got.select("instrument_id", ev.edge_state(F.col("in_a"), F.col("other"), F.col("anchor").isin("BOTH_AGREE", "BOTH_DISAGREE"), F.col("anchor") == "BOTH_AGREE").alias("edge"))


EDGES_SQL = with_bars(
    """SELECT instrument_id, CASE WHEN in_a > 0 THEN 'CHANGED' WHEN other > 0 THEN 'INCONCLUSIVE' WHEN anchor NOT IN ('BOTH_AGREE', 'BOTH_DISAGREE') THEN 'ANCHOR_MISSING' WHEN anchor <> 'BOTH_AGREE' THEN 'ANCHOR_DISAGREES' ELSE 'CONFIRMED' END AS edge
FROM (SELECT instrument_id, count(*) FILTER (gap AND state <> 'B_ONLY') AS in_a, count(*) FILTER (gap AND state <> 'B_ONLY') AS other, arg_min(state, trade_date) FILTER (trade_date >= DATE '1996-04-01') AS anchor
  FROM (SELECT coalesce(a.instrument_id, b.instrument_id) AS instrument_id, coalesce(a.trade_date, b.trade_date) AS trade_date, strftime(coalesce(a.trade_date, b.trade_date), '%Y-%m') = '1996-03' AS gap,
    CASE WHEN b.trade_date IS NULL THEN 'A_ONLY' WHEN a.trade_date IS NULL THEN 'B_ONLY' WHEN a.close = b.close THEN 'BOTH_AGREE' ELSE 'BOTH_DISAGREE' END AS state
    FROM (SELECT * FROM bars WHERE strftime(trade_date, '%Y-%m') <> '1996-03' OR instrument_id = 'I1') a FULL JOIN second b ON b.instrument_id = a.instrument_id AND b.trade_date = a.trade_date) GROUP BY 1)""",
    SECOND,
)


def gap_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange sessions that the first provider lacks, and whether the second has them."""
    d = derive_bars(spark, sf_dir)
    from datetime import date

    days = ql.sessions(spark, date(1996, 1, 1), date(1996, 12, 31)).withColumn("one", F.lit(1))
    ids = src.instruments(spark, sf_dir).select("instrument_id", F.lit(1).alias("one"))
    expected = days.join(F.broadcast(ids), "one").drop("one")
    thin = d.where(F.dayofyear("trade_date") % 19 != 0)
    missing = expected.join(thin.select("instrument_id", "trade_date"), ["instrument_id", "trade_date"], "left_anti")
    other = src.second_provider(d).select("instrument_id", "trade_date", F.lit(True).alias("there"))
    return missing.join(other, ["instrument_id", "trade_date"], "left").groupBy("instrument_id").agg(F.count("*").alias("missing"), F.count("there").alias("validated"))


def _gap_sql() -> str:
    from datetime import date

    closed = ", ".join(f"(DATE '{d}')" for d in sorted(ql.holidays(1996)))
    sessions = f"days AS (SELECT d AS trade_date FROM (SELECT CAST(unnest(generate_series(DATE '{date(1996, 1, 1)}', DATE '{date(1996, 12, 31)}', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND d NOT IN (SELECT c FROM (VALUES {closed}) v(c)))"
    return with_bars(
        """SELECT x.instrument_id, count(*) AS missing, count(s.trade_date) AS validated FROM (SELECT instrument_id, trade_date FROM instruments, days) x
  LEFT JOIN (SELECT * FROM bars WHERE dayofyear(trade_date) % 19 <> 0) b ON b.instrument_id = x.instrument_id AND b.trade_date = x.trade_date
  LEFT JOIN second s ON s.instrument_id = x.instrument_id AND s.trade_date = x.trade_date WHERE b.trade_date IS NULL GROUP BY 1""",
        INSTRUMENTS_CTE,
        SECOND,
        sessions,
    )


def split_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On prices that half of the instruments carry raw, and the others adjusted."""
    d, actions = derive_bars(spark, sf_dir), src.corporate_actions(spark, sf_dir)
    first = actions.groupBy("instrument_id").agg(F.min("effective_date").alias("effective_date")).withColumn("ratio", F.lit(2.0))
    odd = F.col("instrument_id").isin("I1", "I3", "I5", "I7")
    d = d.join(first.select("instrument_id", "effective_date"), "instrument_id", "left").withColumn("close", F.when(odd & (F.col("trade_date") < F.col("effective_date")), F.col("close") * 2).otherwise(F.col("close"))).drop("effective_date")
    return ev.split_semantics(d, first)


SPLIT_SEMANTICS_SQL = with_bars(
    """SELECT instrument_id, effective_date, CASE WHEN r IS NULL THEN 'INCONCLUSIVE' WHEN abs(ln(r / 2)) <= 0.18 AND abs(ln(r / 2)) + 0.08 < abs(ln(r)) THEN 'RAW_LIKE' WHEN abs(ln(r)) <= 0.18 AND abs(ln(r)) + 0.08 < abs(ln(r / 2)) THEN 'ADJUSTED_LIKE' ELSE 'INCONCLUSIVE' END AS state
FROM (SELECT f.instrument_id, f.effective_date, arg_max(close, trade_date) FILTER (trade_date < effective_date) * CASE WHEN f.instrument_id IN ('I1', 'I3', 'I5', 'I7') THEN 2 ELSE 1 END / arg_min(close, trade_date) FILTER (trade_date >= effective_date) AS r
  FROM (SELECT instrument_id, min(effective_date) AS effective_date FROM actions GROUP BY 1) f JOIN bars b ON b.instrument_id = f.instrument_id GROUP BY 1, 2)""",
    ACTIONS_CTE,
)


def terminal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.terminal_alignment(derive_bars(spark, sf_dir), src.instruments(spark, sf_dir))


TERMINAL_SQL = with_bars("SELECT i.instrument_id, delisting_date, last_date, datediff('day', delisting_date, last_date) AS day_error, coalesce(abs(datediff('day', delisting_date, last_date)) <= 10, false) AS aligned FROM instruments i LEFT JOIN (SELECT instrument_id, max(trade_date) AS last_date FROM bars GROUP BY 1) b ON b.instrument_id = i.instrument_id WHERE delisting_date IS NOT NULL", INSTRUMENTS_CTE)


def raw_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.raw_profile(damaged(spark, sf_dir))


PROFILE_SQL = with_bars(
    "SELECT instrument_id, count(*) AS n_rows, count(*) FILTER (gap = 0) AS duplicates, count(*) FILTER (close IS NULL) AS missing_close, count(*) FILTER (open < 0 OR volume < 0) AS negative_values, count(*) FILTER (gap > 7) AS calendar_gaps, min(trade_date) AS first_date, max(trade_date) AS last_date FROM (SELECT *, datediff('day', lag(trade_date) OVER (PARTITION BY instrument_id ORDER BY trade_date, arrival), trade_date) AS gap FROM damaged) GROUP BY 1",
    DAMAGED,
)

POLICY = {"bars": 10_000, "instruments": 500, "days": 1825, "delisted": 1, "exchanges": 2}


def sample_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sample_gate(derive_bars(spark, sf_dir), src.instruments(spark, sf_dir), POLICY)


GATE_SQL = with_bars(
    "SELECT *, failures = '' AS passed FROM (SELECT *, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {k} < {v} THEN '{k}' END" for k, v in POLICY.items()) + "], lambda x: x IS NOT NULL), ',') AS failures FROM (SELECT count(*) AS bars, count(DISTINCT instrument_id) AS instruments, CAST(datediff('day', min(trade_date), max(trade_date)) AS BIGINT) AS days FROM bars), (SELECT count(delisting_date) AS delisted, count(DISTINCT exchange) AS exchanges FROM instruments))",
    INSTRUMENTS_CTE,
)


def correction_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive_bars(spark, sf_dir)
    after = d.where("instrument_id <> 'I7'").withColumn("close", F.when((F.col("instrument_id") == "I2") & (F.col("signal_index") == 5), F.col("close") + 1).otherwise(F.col("close")))
    return ev.correction_probe(d, after, ["open", "high", "low", "close", "volume"])


PROBE_SQL = with_bars("SELECT DISTINCT instrument_id, CASE instrument_id WHEN 'I7' THEN 'NOT_COMPARABLE' WHEN 'I2' THEN 'REVISED' ELSE 'IDENTICAL' END AS state FROM bars")


def match_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates, customers as reference: symbols are key modulo, exchanges nation parity."""
    s, c = src.table(spark, sf_dir, "supplier"), src.table(spark, sf_dir, "customer")
    exchange = lambda k: F.when(F.col(k) % 3 == 0, "XNYS").otherwise(" xnas ")
    return ev.match_reference(s.select(F.col("s_suppkey").alias("candidate_id"), F.concat(F.lit("s"), (F.col("s_suppkey") % 90).cast("string")).alias("symbol"), exchange("s_nationkey").alias("exchange")), c.select(F.col("c_custkey").alias("reference_id"), F.concat(F.lit(" S"), (F.col("c_custkey") % 601).cast("string")).alias("symbol"), exchange("c_nationkey").alias("exchange")))


MATCH_SQL = """SELECT candidate_id, state, CASE state WHEN 'EXACT' THEN exact_id WHEN 'SYMBOL_ONLY' THEN any_id ELSE -1 END AS reference_id FROM (
  SELECT candidate_id, exact_id, any_id, CASE WHEN exact = 1 THEN 'EXACT' WHEN exact > 1 THEN 'AMBIGUOUS' WHEN by_symbol = 1 THEN 'SYMBOL_ONLY' WHEN by_symbol > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS state FROM (
    SELECT s_suppkey AS candidate_id, count(*) FILTER ((s_nationkey % 3 = 0) = (c_nationkey % 3 = 0)) AS exact, count(c_custkey) AS by_symbol, min(c_custkey) FILTER ((s_nationkey % 3 = 0) = (c_nationkey % 3 = 0)) AS exact_id, min(c_custkey) AS any_id
    FROM supplier LEFT JOIN customer ON c_custkey % 601 = s_suppkey % 90 GROUP BY 1))"""


def stratified_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ev.stratified(c, "c_mktsegment", "c_custkey", "seed-7", 5).select("c_mktsegment", "c_custkey", F.col("place").cast("bigint").alias("place"))


STRATIFIED_SQL = "SELECT c_mktsegment, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat('seed-7|', CAST(c_custkey AS VARCHAR))), c_custkey) AS place FROM customer) WHERE place <= 5"


def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 30 days and four symbols; the digest in their ids hangs on the plan's, which SQL does not have."""
    symbols = src.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("symbol")).distinct()
    _, batches = bf.plan(symbols, "synthetic", "2024-01-01", "2024-03-31", 30, 4)
    return batches.select("sequence", F.substring("batch_id", 1, 12).alias("batch"), "window_start", "window_end", F.concat_ws(",", "symbols").alias("symbols"))


BACKFILL_SQL = """SELECT sequence, 'batch-' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS batch, window_start, least(window_start + 29, DATE '2024-03-31') AS window_end, symbols
FROM (SELECT *, w * (max(chunk) OVER () + 1) + chunk + 1 AS sequence, DATE '2024-01-01' + CAST(w * 30 AS INT) AS window_start
  FROM (SELECT chunk, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM (SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1) // 4 AS chunk FROM (SELECT DISTINCT s_name AS symbol FROM supplier)) GROUP BY 1), range(4) r(w))"""


def policy_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit policies that another one dominates on expectancy, win rate and median adverse move."""
    events, bars = raw_breakouts(spark, sf_dir)
    s = round_all(risk.exit_summary(risk.exit_results(events, bars, 20))).select(F.col("policy_id").alias("config"), "expectancy", "win_rate", "median_mae")
    return ev.dominance(s, ["expectancy", "win_rate", "median_mae"], [])


#: Horizons of the family.
FAMILY = (2, 3, 5, 10, 20, 40, 60)


def horizon_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge of each horizon: mean, interval, sign-flip p with Benjamini-Hochberg over the family."""
    rows = st.months(staged_returns(spark, sf_dir, FAMILY), "signal_date")
    monthly = rows.groupBy("horizon", "month").agg(F.sum("forward_return").alias("total"), F.count("*").alias("n"))
    bounds = st.month_bootstrap(monthly, BOOTSTRAPS, 20260817, ["horizon"])
    parts = [st.sign_flip(monthly.where(F.col("horizon") == h).select("month", (F.col("total") / F.col("n")).alias("gap")), FLIPS, 20260817 + h * 10_000).select(F.lit(h).alias("horizon"), F.col("p_value").alias("p")) for h in FAMILY]
    tests = reduce(DataFrame.unionByName, parts).withColumn("hypothesis", F.concat(F.lit("h"), F.lpad(F.col("horizon").cast("string"), 3, "0")))
    means = rows.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean_return"))
    return round_all(means.join(bounds, "horizon").join(st.adjusted(tests, "benjamini_hochberg"), "horizon").select("horizon", "n", "mean_return", "low", "high", "p", "p_adjusted"))


PARENTS = {"t1": "t0", "t2": "t1", "t3": "t1", "t4": "t3", "t5": "t2"}


def trend_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts against their parents: excess of the mean 20-bar return, and its sign-flip p over months."""
    bars = derive_bars(spark, sf_dir)
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    returns = bars.withColumn("ret", F.lead("close", 20).over(w) / F.lead("open", 1).over(w) - 1).where("ret is not null").select("instrument_id", "trade_date", "ret")
    rows = returns.join(pt.trend_contexts(bars, market_benchmark(bars)), ["instrument_id", "trade_date"])
    monthly = st.months(rows, "trade_date").groupBy("month").agg(*[F.avg(F.when(F.col(t), F.col("ret"))).alias(t) for t in ("t0", *PARENTS)])
    out = None
    for i, (child, parent) in enumerate(PARENTS.items()):
        gaps = monthly.select("month", (F.col(child) - F.col(parent)).alias("gap")).where("gap is not null")
        one = st.sign_flip(gaps, FLIPS, 100 + i).select(F.lit(child).alias("hypothesis"), F.lit(parent).alias("parent"), "observed", F.col("p_value").alias("p"))
        out = one if out is None else out.unionByName(one)
    return round_all(st.adjusted(out, "benjamini_hochberg"))


def atr_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initial stop levels by family at each breakout: fixed, ATR, structural low, hybrid; and the share at risk."""
    from tidemark.functions import indicators as ind

    bars = derive_bars(spark, sf_dir).withColumn("tr", ind.true_range())
    base = pt.bases(bars, 20, 0.08, "NONE").withColumn("atr", ind.atr(14))
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    rows = base.withColumn("entry", F.lead("open", 1).over(w)).where(F.col("qualified") & (F.col("cc") > F.col("hc_most")) & F.col("entry").isNotNull() & F.col("atr").isNotNull())
    support = F.col("lc_least") / F.lit(100.0)
    levels = {"fixed_5": F.col("entry") * 0.95, "atr_2": F.col("entry") - 2 * F.col("atr"), "structural_low": support, "hybrid": F.least(support, F.col("entry") - 2 * F.col("atr"))}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("stop")) for k, v in levels.items()])).alias("x")
    got = rows.select("instrument_id", "entry", pairs).select("instrument_id", "entry", "x.family", "x.stop")
    return round_all(got.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("stop") >= F.col("entry")).alias("not_below_entry"), F.avg(1 - F.col("stop") / F.col("entry")).alias("mean_risk")))


ATR_STOPS_SQL = with_bars(
    """SELECT family, count(*) AS n, count(*) FILTER (stop >= entry) AS not_below_entry, round(avg(1 - stop / entry), 8) AS mean_risk FROM (
  SELECT entry, unnest(['fixed_5', 'atr_2', 'structural_low', 'hybrid']) AS family, unnest([entry * 0.95::DOUBLE, entry - 2 * atr, lm / 100.0::DOUBLE, least(lm / 100.0::DOUBLE, entry - 2 * atr)]) AS stop
  FROM rows WHERE (hm - lm) * 100 <= 8 * lm AND cc > hm AND entry IS NOT NULL AND atr IS NOT NULL) GROUP BY 1""",
    TR,
    f"rows AS (SELECT *, {q_full('max', 'hc', 20, -1)} AS hm, {q_full('min', 'lc', 20, -1)} AS lm, {q_full('avg', 'tr', 14)} AS atr, lead(open) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS entry FROM tr)",
)


def population_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the sorted event ids of each instrument."""
    events, _ = raw_breakouts(spark, sf_dir)
    ids = F.concat_ws("@", "instrument_id", F.lpad(F.col("signal_index").cast("string"), 8, "0"))
    return events.groupBy("instrument_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(ids))), 256).alias("fingerprint"), F.count("*").alias("n"))


FINGERPRINT_SQL = with_bars("SELECT instrument_id, sha256(string_agg(concat(instrument_id, '@', lpad(CAST(signal_index AS VARCHAR), 8, '0')), chr(10) ORDER BY signal_index)) AS fingerprint, count(*) AS n FROM ev GROUP BY 1", BASE, EV)

QUERIES = {
    "store_round_trip": (store_round_trip, STORE_SQL),
    "normalise_bars": (normalise_bars, NORMALISE_SQL),
    "coverage_checks": (coverage_checks, COVERAGE_SQL),
    "coverage_edges": (coverage_edges, EDGES_SQL),
    "gap_validation": (gap_validation, _gap_sql()),
    "split_semantics": (split_semantics, SPLIT_SEMANTICS_SQL),
    "terminal_alignment": (terminal_alignment, TERMINAL_SQL),
    "raw_profile": (raw_profile, PROFILE_SQL),
    "sample_gate": (sample_gate, GATE_SQL),
    "correction_probe": (correction_probe, PROBE_SQL),
    "match_reference": (match_reference, MATCH_SQL),
    "stratified_selection": (stratified_selection, STRATIFIED_SQL),
    "backfill_plan": (backfill_plan, BACKFILL_SQL),
    "atr_stops": (atr_stops, ATR_STOPS_SQL),
    "population_fingerprint": (population_fingerprint, FINGERPRINT_SQL),
    "policy_dominance": (policy_dominance, None),
    "horizon_family": (horizon_family, None),
    "trend_family": (trend_family, None),
}
