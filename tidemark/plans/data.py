"""Queries of scans, serving, quality, calendar, identity, provider comparison, revisions, universes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as ql
from tidemark.plans.strategy import round_all
from tidemark.sources import bars as src
from tidemark.sources.bars import ACTIONS_CTE, INSTRUMENTS_CTE, derive_bars, with_bars

BAR_COLUMNS = ("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "signal_index")


def bars_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_bars(spark, sf_dir).select(*BAR_COLUMNS)


def research_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = src.research_bars(src.canonical(derive_bars(spark, sf_dir)))
    return got.select("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "quality_status", "price_representation")


def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.window_scan(derive_bars(spark, sf_dir), ["I1", "I2", "I5"], "1997-01-01", "1997-06-30", 30).select("instrument_id", "trade_date", "close")


WINDOW_SQL = with_bars(
    """SELECT instrument_id, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, trade_date < DATE '1997-01-01' ORDER BY trade_date DESC) AS age FROM bars WHERE instrument_id IN ('I1', 'I2', 'I5') AND trade_date <= DATE '1997-06-30')
WHERE trade_date >= DATE '1997-01-01' OR age <= 30"""
)


def content_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free content summary per instrument."""
    d = derive_bars(spark, sf_dir)
    cell = F.conv(F.substring(F.md5(F.concat_ws("|", "instrument_id", F.col("trade_date").cast("string"), F.col("cc").cast("string"), F.col("oc").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return d.groupBy("instrument_id").agg(F.count("*").alias("n"), F.sum(cell).alias("checksum"))


CHECKSUM_SQL = with_bars("SELECT instrument_id, count(*) AS n, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|', instrument_id, CAST(trade_date AS VARCHAR), CAST(cc AS VARCHAR), CAST(oc AS VARCHAR))), 1, 8)) AS BIGINT)) AS BIGINT) AS checksum FROM bars GROUP BY 1")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted faults, and some rows twice; ``arrival`` tells the copies apart."""
    d = derive_bars(spark, sf_dir).select(*BAR_COLUMNS)
    k = F.col("signal_index")
    d = d.withColumn("high", F.when(k % 101 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(k % 103 == 0, -F.col("volume")).otherwise(F.col("volume")))
    d = d.withColumn("close", F.when(k % 107 == 0, F.col("high") + 5).when(k % 109 == 0, F.lit(None)).otherwise(F.col("close"))).withColumn("open", F.when(k % 113 == 0, F.lit(-1.0)).otherwise(F.col("open")))
    return d.withColumn("arrival", F.lit(0)).unionByName(d.where(k % 97 == 0).withColumn("arrival", F.lit(1)))


DAMAGED = """damaged AS MATERIALIZED (SELECT *, unnest(CASE WHEN signal_index % 97 = 0 THEN [0, 1] ELSE [0] END) AS arrival FROM (
  SELECT instrument_id, trade_date, signal_index, CASE WHEN signal_index % 113 = 0 THEN -1.0 ELSE open END AS open, high, low, CASE WHEN signal_index % 107 = 0 THEN high + 5 WHEN signal_index % 109 = 0 THEN NULL ELSE close END AS close, volume
  FROM (SELECT instrument_id, trade_date, signal_index, open, CASE WHEN signal_index % 101 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN signal_index % 103 = 0 THEN -volume ELSE volume END AS volume FROM bars)))"""
ISSUES = """issues AS MATERIALIZED (SELECT instrument_id, trade_date, x.issue AS issue, x.status AS status FROM (SELECT *, unnest(list_filter([
    CASE WHEN arrival > 0 THEN {'issue': 'DUPLICATE', 'status': 'REJECT'} END,
    CASE WHEN close IS NULL THEN {'issue': 'NON_FINITE', 'status': 'REJECT'} END,
    CASE WHEN close IS NOT NULL AND least(open, high, low, close) < 0 THEN {'issue': 'NEGATIVE_PRICE', 'status': 'REJECT'} END,
    CASE WHEN close IS NOT NULL AND volume < 0 THEN {'issue': 'NEGATIVE_VOLUME', 'status': 'REJECT'} END,
    CASE WHEN close IS NOT NULL AND high < low THEN {'issue': 'HIGH_BELOW_LOW', 'status': 'REJECT'} END,
    CASE WHEN close IS NOT NULL AND high >= low AND (open > high OR open < low) THEN {'issue': 'OPEN_OUTSIDE_RANGE', 'status': 'QUARANTINE'} END,
    CASE WHEN close IS NOT NULL AND high >= low AND (close > high OR close < low) THEN {'issue': 'CLOSE_OUTSIDE_RANGE', 'status': 'QUARANTINE'} END], lambda y: y IS NOT NULL)) AS x FROM damaged))"""


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.issues(damaged(spark, sf_dir))


def quality_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by instrument and worst state."""
    bad = damaged(spark, sf_dir)
    return ql.annotate(bad, ql.issues(bad)).groupBy("instrument_id", "quality_status").agg(F.count("*").alias("n"))


STATES_SQL = with_bars(
    """SELECT instrument_id, quality_status, count(*) AS n FROM (SELECT d.instrument_id, coalesce(s, 'PASS') AS quality_status FROM damaged d
  LEFT JOIN (SELECT instrument_id, trade_date, CASE WHEN max(CAST(status = 'REJECT' AS INT)) = 1 THEN 'REJECT' ELSE 'QUARANTINE' END AS s FROM issues GROUP BY 1, 2) i ON i.instrument_id = d.instrument_id AND i.trade_date = d.trade_date) GROUP BY 1, 2""",
    DAMAGED,
    ISSUES,
)


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a second provider against those of the first."""
    d = derive_bars(spark, sf_dir)
    return round_all(ql.completeness(d, src.second_provider(d)))


SECOND = "second AS (SELECT instrument_id, trade_date, open, high, low, CASE WHEN dayofyear(trade_date) % 17 = 0 THEN close + 0.25::DOUBLE ELSE close END AS close, volume FROM bars WHERE dayofyear(trade_date) % 23 <> 0)"
COMPLETENESS_SQL = with_bars(
    """SELECT instrument_id, expected, missing, unexpected, round(missing / CAST(expected AS DOUBLE), 8) AS missing_fraction, CASE WHEN missing / CAST(expected AS DOUBLE) > 0.05 THEN 'QUARANTINE' WHEN missing / CAST(expected AS DOUBLE) > 0.01 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT coalesce(b.instrument_id, s.instrument_id) AS instrument_id, count(b.trade_date) AS expected, count(*) FILTER (s.trade_date IS NULL) AS missing, count(*) FILTER (b.trade_date IS NULL) AS unexpected FROM bars b FULL JOIN second s ON s.instrument_id = b.instrument_id AND s.trade_date = b.trade_date GROUP BY 1)""",
    SECOND,
)


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.cross_section(src.second_provider(derive_bars(spark, sf_dir)), 7, 8)


CROSS_SQL = with_bars("SELECT trade_date, count(DISTINCT instrument_id) AS instruments, CASE WHEN count(DISTINCT instrument_id) BETWEEN 7 AND 8 THEN 'PASS' ELSE 'WARN' END AS status FROM second GROUP BY 1", SECOND)


def price_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.price_jumps(derive_bars(spark, sf_dir), src.corporate_actions(spark, sf_dir), 0.9)


JUMPS = "jumps AS (SELECT * FROM (SELECT *, lag(close) OVER w AS prev_close, lag(trade_date) OVER w AS prev_date FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date)) m WHERE prev_close > 0 AND round(abs(close / prev_close - 1) * 100, 8) >= 0.9 AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.instrument_id = m.instrument_id AND a.effective_date > m.prev_date AND a.effective_date <= m.trade_date))"
JUMPS_SQL = with_bars("SELECT instrument_id, trade_date, prev_date, close, prev_close FROM jumps", ACTIONS_CTE, JUMPS)


def jump_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = src.corporate_actions(spark, sf_dir)
    return ql.nearby_actions(ql.price_jumps(derive_bars(spark, sf_dir), actions, 0.9), actions, 3)


JUMP_ACTIONS_SQL = with_bars("SELECT j.instrument_id, j.trade_date, coalesce(string_agg(DISTINCT action_type, ','), '') AS action_types, count(a.effective_date) AS n_actions FROM jumps j LEFT JOIN actions a ON a.instrument_id = j.instrument_id AND abs(datediff('day', a.effective_date, j.trade_date)) <= 3 GROUP BY 1, 2", ACTIONS_CTE, JUMPS)

CALENDAR = (date(1994, 1, 1), date(1999, 12, 31))


def audit_sessions(spark: SparkSession, d: DataFrame, first: date, last: date) -> DataFrame:
    """Per instrument: exchange sessions inside its span, missing ones, bars on days without a session."""
    span = d.groupBy("instrument_id").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = ql.sessions(spark, first, last)
    expected = days.withColumn("one", F.lit(1)).join(F.broadcast(span.withColumn("one", F.lit(1))), "one").where(F.col("trade_date").between(F.col("a"), F.col("b")))
    inside = d.where(F.col("trade_date").between(F.lit(first), F.lit(last)))
    return ql.completeness(expected.select("instrument_id", "trade_date"), inside).select("instrument_id", "expected", "missing", "unexpected")


def session_audit_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit from the first bar to the last, whatever years these are in."""
    d = derive_bars(spark, sf_dir)
    first, last = d.agg(F.min("trade_date"), F.max("trade_date")).first()
    today = date.today()
    return audit_sessions(spark, d, first or today, last or today)


_CLOSED = ", ".join(f"(DATE '{d}')" for d in sorted({d for y in range(CALENDAR[0].year, CALENDAR[1].year + 1) for d in ql.holidays(y)} | {date.fromisoformat(x) for x in ql.CLOSURES}))
SESSIONS = f"sessions AS (SELECT d AS trade_date FROM (SELECT CAST(unnest(generate_series(DATE '{CALENDAR[0]}', DATE '{CALENDAR[1]}', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND d NOT IN (SELECT c FROM (VALUES {_CLOSED}) v(c)))"
#: Years whose closed days the SQL of the whole span lists.
SPAN_YEARS = range(1970, 2100)
_SPAN_CLOSED = ", ".join(f"(DATE '{d}')" for d in sorted({d for y in SPAN_YEARS for d in ql.holidays(y)} | {date.fromisoformat(x) for x in ql.CLOSURES}))
SPAN_AUDIT_SQL = with_bars(
    """SELECT coalesce(e.instrument_id, o.instrument_id) AS instrument_id, count(e.trade_date) AS expected, count(*) FILTER (o.trade_date IS NULL) AS missing, count(*) FILTER (e.trade_date IS NULL) AS unexpected
FROM (SELECT instrument_id, trade_date FROM days, (SELECT instrument_id, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1) WHERE trade_date BETWEEN a AND b) e
FULL JOIN bars o ON o.instrument_id = e.instrument_id AND o.trade_date = e.trade_date GROUP BY 1""",
    f"days AS (SELECT d AS trade_date FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM bars)) WHERE isodow(d) < 6 AND d NOT IN (SELECT c FROM (VALUES {_SPAN_CLOSED}) v(c)))",
)


def session_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each instrument from its listing to its delisting, some bars sent twice, and an instrument without bars."""
    d = derive_bars(spark, sf_dir)
    bars = d.unionByName(d.where(F.dayofyear("trade_date") == 50))
    listed = src.instruments(spark, sf_dir).select("instrument_id", "exchange", "first_trade_date", "delisting_date")
    listed = listed.unionByName(listed.where("instrument_id = 'I0'").withColumn("instrument_id", F.lit("none")))
    span = d.agg(F.min("trade_date"), F.max("trade_date")).first()
    got = ql.session_completeness(bars, listed, span[1], span[0])
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return got.select("instrument_id", "expected_start", "expected_end", "observed_first", "observed_last", "observed", "expected", "duplicates", "missing_history", text("missing"), text("unexpected"), "complete")


COMPLETE_SQL = with_bars(
    """SELECT instrument_id, expected_start, expected_end, observed_first, observed_last, coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected, coalesce(duplicates, 0) AS duplicates, observed IS NULL AND NOT expected_start > expected_end AS missing_history,
  coalesce(missing, '') AS missing, coalesce(unexpected, '') AS unexpected, observed IS NOT NULL AND duplicates = 0 AND missing IS NULL AND unexpected IS NULL AS complete
FROM (SELECT l.instrument_id, greatest(coalesce(first_trade_date, observed_first), (SELECT min(trade_date) FROM bars)) AS expected_start, least(delisting_date, (SELECT max(trade_date) FROM bars)) AS expected_end, observed_first, observed_last, observed, duplicates
  FROM listed l LEFT JOIN (SELECT instrument_id, min(trade_date) AS observed_first, max(trade_date) AS observed_last, count(*) + count(*) FILTER (dayofyear(trade_date) = 50) AS observed, count(*) FILTER (dayofyear(trade_date) = 50) AS duplicates FROM bars GROUP BY 1) o ON o.instrument_id = l.instrument_id)
LEFT JOIN (SELECT instrument_id, count(e) AS expected, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) FILTER (o IS NULL) AS missing, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) FILTER (e IS NULL) AS unexpected
  FROM (SELECT coalesce(x.instrument_id, b.instrument_id) AS instrument_id, x.trade_date AS e, b.trade_date AS o
    FROM (SELECT instrument_id, days.trade_date FROM days, listed WHERE days.trade_date BETWEEN first_trade_date AND coalesce(delisting_date, DATE '9999-12-31') AND instrument_id <> 'none') x
    FULL JOIN bars b ON b.instrument_id = x.instrument_id AND b.trade_date = x.trade_date) GROUP BY 1) USING (instrument_id)""",
    INSTRUMENTS_CTE,
    "listed AS (SELECT instrument_id, first_trade_date, delisting_date FROM instruments UNION ALL SELECT 'none', first_trade_date, delisting_date FROM instruments WHERE instrument_id = 'I0')",
    f"days AS (SELECT d AS trade_date FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM bars)) WHERE isodow(d) < 6 AND d NOT IN (SELECT c FROM (VALUES {_SPAN_CLOSED}) v(c)))",
)


def symbol_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbol intervals per instrument, split on 1996-06-30."""
    d = derive_bars(spark, sf_dir)
    ids = src.instruments(spark, sf_dir).select("instrument_id")
    old = ids.select("instrument_id", F.concat(F.lit("OLD_"), "instrument_id").alias("symbol"), F.lit("1900-01-01").cast("date").alias("effective_from"), F.lit("1996-06-30").cast("date").alias("effective_to"))
    new = ids.select("instrument_id", F.concat(F.lit("NEW_"), "instrument_id").alias("symbol"), F.lit("1996-07-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return ql.symbol_as_of(d.select("instrument_id", "trade_date"), old.unionByName(new)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


SYMBOL_SQL = with_bars("SELECT CASE WHEN trade_date <= DATE '1996-06-30' THEN 'OLD_' ELSE 'NEW_' END || instrument_id AS symbol, count(*) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars GROUP BY 1")


def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider identifiers of suppliers, resolved by the master of even ones; unresolved rows are counted."""
    rows = src.table(spark, sf_dir, "supplier").select(F.lit("synthetic").alias("provider_id"), F.col("s_suppkey").cast("string").alias("provider_instrument_id"))
    master = rows.where("cast(provider_instrument_id as bigint) % 2 = 0").withColumn("instrument_id", ql.instrument_id(F.col("provider_id"), F.col("provider_instrument_id")))
    found, missing = ql.resolve(rows, master)
    both = found.select("provider_instrument_id", F.lit("RESOLVED").alias("state"), "instrument_id")
    return both.unionByName(missing.select("provider_instrument_id", F.lit("UNRESOLVED").alias("state"), F.lit(None).cast("string").alias("instrument_id")))


_DIGEST = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('synthetic:' || s_suppkey))"
IDENTITY_SQL = f"""SELECT CAST(s_suppkey AS VARCHAR) AS provider_instrument_id, CASE WHEN s_suppkey % 2 = 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS state,
  CASE WHEN s_suppkey % 2 = 0 THEN 'tsi_' || substr({_DIGEST}, 1, 12) || '5' || substr({_DIGEST}, 14, 3) || lower(to_hex((CAST('0x' || substr({_DIGEST}, 17, 1) AS INT) & 3) | 8)) || substr({_DIGEST}, 18, 15) END AS instrument_id
FROM supplier"""


def composite_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive_bars(spark, sf_dir)
    a, b = d.where(F.dayofyear("trade_date") % 19 != 0), src.second_provider(d)
    return ql.evidence(a, b).select("instrument_id", "trade_date", "state", F.concat_ws(",", "differing").alias("differing"))


EVIDENCE = """evidence AS (SELECT coalesce(a.instrument_id, b.instrument_id) AS instrument_id, coalesce(a.trade_date, b.trade_date) AS trade_date,
  CASE WHEN b.trade_date IS NULL THEN 'A_ONLY' WHEN a.trade_date IS NULL THEN 'B_ONLY' WHEN a.close = b.close THEN 'BOTH_AGREE' ELSE 'BOTH_DISAGREE' END AS state,
  CASE WHEN a.trade_date IS NOT NULL AND b.trade_date IS NOT NULL AND a.close <> b.close THEN 'close' ELSE '' END AS differing
  FROM (SELECT * FROM bars WHERE dayofyear(trade_date) % 19 <> 0) a FULL JOIN second b ON b.instrument_id = a.instrument_id AND b.trade_date = a.trade_date)"""


def composite_adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive_bars(spark, sf_dir)
    return ql.adjudicate(ql.evidence(d.where(F.dayofyear("trade_date") % 19 != 0), src.second_provider(d)))


ADJUDICATE_SQL = with_bars(
    "SELECT instrument_id, trade_date, CASE state WHEN 'BOTH_AGREE' THEN 'CORROBORATED' WHEN 'BOTH_DISAGREE' THEN 'DISCREPANCY_REVIEW_REQUIRED' ELSE 'GAP_REVIEW_REQUIRED' END AS decision, substr(sha256(concat(instrument_id, '|', CAST(trade_date AS VARCHAR), '|A|B|', state, '|', differing)), 1, 24) AS review_id FROM evidence",
    SECOND,
    EVIDENCE,
)


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of two providers under a tolerance, by instrument."""
    d = derive_bars(spark, sf_dir)
    b = src.second_provider(d).select("instrument_id", "trade_date", F.col("close").alias("other"))
    joined = d.join(b, ["instrument_id", "trade_date"], "left")
    state = F.when(F.col("other").isNull(), "MISSING").when(ql.is_close(F.col("close"), F.col("other"), 0.0025, 0.01), "MATCH").otherwise("MISMATCH")
    return joined.groupBy("instrument_id").agg(*[F.count_if(state == s).alias(s.lower()) for s in ("MATCH", "MISMATCH", "MISSING")])


RECONCILE_SQL = with_bars(
    "SELECT instrument_id, count(*) FILTER (o IS NOT NULL AND near) AS match, count(*) FILTER (o IS NOT NULL AND NOT near) AS mismatch, count(*) FILTER (o IS NULL) AS missing FROM (SELECT b.instrument_id, s.close AS o, abs(b.close - s.close) <= greatest(0.0025::DOUBLE * greatest(abs(b.close), abs(s.close)), 0.01::DOUBLE) AS near FROM bars b LEFT JOIN second s ON s.instrument_id = b.instrument_id AND s.trade_date = b.trade_date) GROUP BY 1",
    SECOND,
)


def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of two providers alone and together."""
    d = derive_bars(spark, sf_dir)
    found = ql.evidence(d.where(F.dayofyear("trade_date") % 19 != 0), src.second_provider(d)).select("instrument_id", "trade_date", "state")
    both = d.select("instrument_id", "trade_date").join(found, ["instrument_id", "trade_date"], "left")
    n = F.count("*")
    in_a, in_b = F.count_if(F.col("state").isNotNull() & (F.col("state") != "B_ONLY")), F.count_if(F.col("state").isNotNull() & (F.col("state") != "A_ONLY"))
    return round_all(both.groupBy("instrument_id").agg(F.count_if(F.col("state").isNull()).alias("both_missing"), (in_a / n).alias("coverage_a"), (in_b / n).alias("coverage_b"), (F.count("state") / n).alias("coverage_union")))


COMPLEMENT_SQL = with_bars(
    "SELECT b.instrument_id, count(*) FILTER (state IS NULL) AS both_missing, round(count(*) FILTER (state <> 'B_ONLY') / CAST(count(*) AS DOUBLE), 8) AS coverage_a, round(count(*) FILTER (state <> 'A_ONLY') / CAST(count(*) AS DOUBLE), 8) AS coverage_b, round(count(state) / CAST(count(*) AS DOUBLE), 8) AS coverage_union FROM bars b LEFT JOIN evidence e ON e.instrument_id = b.instrument_id AND e.trade_date = b.trade_date GROUP BY 1",
    SECOND,
    EVIDENCE,
)


def revision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second provider's late rows as corrections: rows by change and their closes."""
    d = derive_bars(spark, sf_dir)
    got = ql.merge_revision(d, src.second_provider(d).where("trade_date >= '1996-01-01'"), "1996-01-01", "v2")
    return round_all(got.groupBy("instrument_id", "change", "dataset_version").agg(F.count("*").alias("n"), F.max("close").alias("max_close")))


REVISION_SQL = with_bars(
    "SELECT b.instrument_id, CASE WHEN s.trade_date IS NULL THEN 'CARRIED' WHEN s.close = b.close THEN 'UNCHANGED' ELSE 'REVISED' END AS change, 'v2' AS dataset_version, count(*) AS n, round(max(coalesce(s.close, b.close)), 8) AS max_close FROM bars b LEFT JOIN (SELECT * FROM second WHERE trade_date >= DATE '1996-01-01') s ON s.instrument_id = b.instrument_id AND s.trade_date = b.trade_date GROUP BY 1, 2, 3",
    SECOND,
)


def compose_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive_bars(spark, sf_dir).select(*BAR_COLUMNS)
    year = F.year("trade_date")
    return ql.compose([d.where(year <= 1995), d.where(year > 1995)], "joined-v1").groupBy("dataset_version", "instrument_id").agg(F.count("*").alias("n"))


COMPOSE_SQL = with_bars("SELECT 'joined-v1' AS dataset_version, instrument_id, count(*) AS n FROM bars GROUP BY 2")


def split_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ql.split_factors(derive_bars(spark, sf_dir), src.corporate_actions(spark, sf_dir))
    return got.select("instrument_id", "trade_date", F.round("split_log2").cast("int").alias("log2_factor"))


SPLIT_SQL = with_bars("SELECT b.instrument_id, b.trade_date, -CAST(count(a.effective_date) AS INT) AS log2_factor FROM bars b LEFT JOIN actions a ON a.instrument_id = b.instrument_id AND a.effective_date > b.trade_date GROUP BY 1, 2", ACTIONS_CTE)


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive_bars(spark, sf_dir)
    return ql.universe(d, src.instruments(spark, sf_dir), d.select("trade_date").distinct(), 20, 60.0, 3000.0, 60)


def universe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).select("instrument_id", "trade_date", F.round("price", 8).alias("price"), F.round("liquidity", 6).alias("liquidity"), F.col("history").cast("long").alias("history"), "reasons", "eligible")


def universe_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).groupBy("reasons").agg(F.count("*").alias("n"))


UNIVERSE = """measured AS (SELECT instrument_id, trade_date, close AS price, CASE WHEN count(dv) OVER w = 20 THEN avg(dv) OVER w END AS liquidity, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS history
  FROM (SELECT *, close * volume AS dv FROM bars) WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
grid AS (SELECT i.*, d.trade_date FROM instruments i, (SELECT DISTINCT trade_date FROM bars) d),
members AS (SELECT g.instrument_id, g.trade_date, m.price, m.liquidity, coalesce(m.history, 0) AS history, coalesce(array_to_string(list_filter([
    CASE WHEN g.trade_date < first_trade_date THEN 'BEFORE_FIRST_TRADE' END, CASE WHEN g.trade_date > delisting_date THEN 'AFTER_DELISTING' END, CASE WHEN exchange NOT IN ('XNYS', 'XNAS') THEN 'EXCHANGE' END,
    CASE WHEN security_type <> 'COMMON_STOCK' THEN 'SECURITY_TYPE' END, CASE WHEN m.price IS NULL THEN 'QUALITY' END,
    CASE WHEN m.price IS NULL THEN 'PRICE_MISSING' WHEN m.price < 60 THEN 'PRICE_BELOW_MINIMUM' END,
    CASE WHEN m.liquidity IS NULL THEN 'LIQUIDITY_MISSING' WHEN round(m.liquidity, 6) < 3000 THEN 'LIQUIDITY_BELOW_MINIMUM' END,
    CASE WHEN coalesce(m.history, 0) < 60 THEN 'HISTORY_INSUFFICIENT' END], lambda x: x IS NOT NULL), ','), '') AS reasons
  FROM grid g ASOF LEFT JOIN measured m ON m.instrument_id = g.instrument_id AND m.trade_date <= g.trade_date)"""
UNIVERSE_SQL = with_bars("SELECT instrument_id, trade_date, round(price, 8) AS price, round(liquidity, 6) AS liquidity, history, reasons, reasons = '' AS eligible FROM members", INSTRUMENTS_CTE, UNIVERSE)
EXCLUSIONS_SQL = with_bars("SELECT reasons, count(*) AS n FROM members GROUP BY 1", INSTRUMENTS_CTE, UNIVERSE)


def serve_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served rows of two years with their membership, by instrument."""
    d = derive_bars(spark, sf_dir)
    got = src.serve(d, _universe(spark, sf_dir), "1996-01-01", "1997-12-31")
    return got.groupBy("instrument_id").agg(F.count("*").alias("n"), F.count_if("eligibility").alias("eligible"))


SERVE_SQL = with_bars("SELECT b.instrument_id, count(*) AS n, count(*) FILTER (reasons = '') AS eligible FROM bars b JOIN members m ON m.instrument_id = b.instrument_id AND m.trade_date = b.trade_date WHERE b.trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1", INSTRUMENTS_CTE, UNIVERSE)


QUERIES = {
    "bars_derive": (bars_derive, with_bars("SELECT instrument_id, trade_date, open, high, low, close, volume, signal_index FROM bars")),
    "research_bars": (research_rows, with_bars("SELECT instrument_id, trade_date, open, high, low, close, volume, 'PASS' AS quality_status, 'split_adjusted' AS price_representation FROM bars")),
    "scan_window_warmup": (window_scan, WINDOW_SQL),
    "content_checksum": (content_checksum, CHECKSUM_SQL),
    "quality_issues": (quality_issues, with_bars("SELECT instrument_id, trade_date, issue, status FROM issues", DAMAGED, ISSUES)),
    "quality_states": (quality_states, STATES_SQL),
    "completeness_report": (completeness, COMPLETENESS_SQL),
    "cross_section_counts": (cross_section, CROSS_SQL),
    "price_jumps": (price_jumps, JUMPS_SQL),
    "jump_actions": (jump_actions, JUMP_ACTIONS_SQL),
    "session_audit": (session_audit_span, SPAN_AUDIT_SQL),
    "session_completeness": (session_completeness, COMPLETE_SQL),
    "session_audit_span": (session_audit_span, SPAN_AUDIT_SQL),
    "symbol_as_of": (symbol_as_of, SYMBOL_SQL),
    "identity_resolve": (identity_resolve, IDENTITY_SQL),
    "composite_evidence": (composite_evidence, with_bars("SELECT instrument_id, trade_date, state, differing FROM evidence", SECOND, EVIDENCE)),
    "composite_adjudicate": (composite_adjudicate, ADJUDICATE_SQL),
    "reconcile_bars": (reconcile, RECONCILE_SQL),
    "provider_complementarity": (complementarity, COMPLEMENT_SQL),
    "revision_merge": (revision_merge, REVISION_SQL),
    "compose_datasets": (compose_datasets, COMPOSE_SQL),
    "split_adjust": (split_adjust, SPLIT_SQL),
    "universe_history": (universe_history, UNIVERSE_SQL),
    "universe_exclusions": (universe_exclusions, EXCLUSIONS_SQL),
    "serve_research_bars": (serve_research, SERVE_SQL),
}
