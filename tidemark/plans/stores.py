"""Queries of the stores: instrument master, corporate actions, composite bars with provenance, resumed backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import composite as cp
from tidemark.operators import quality as ql
from tidemark.plans.data import EVIDENCE, SECOND
from tidemark.session import shared_path
from tidemark.sources import backfill as bf
from tidemark.sources import bars as src
from tidemark.sources import master as ms
from tidemark.sources.bars import derive_bars, with_bars

DNS = "6ba7b8109dad11d180b400c04fd430c8"


def q_uuid(prefix: str, namespace: str, name: str) -> str:
    """DuckDB text of the name-based UUID."""
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return f"'{prefix}' || substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || lower(to_hex((CAST('0x' || substr({h}, 17, 1) AS INT) & 3) | 8)) || substr({h}, 18, 15)"


def supplier_master(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One instrument a supplier, with ids of two providers, and its symbols before and after a change of name."""
    s = src.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    instruments = s.select(
        ql.instrument_id(F.lit("synthetic"), key).alias("instrument_id"), F.col("s_name").alias("primary_symbol"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, "XNYS").otherwise("XNAS").alias("exchange"), F.when(F.col("s_suppkey") % 5 == 4, "ETF").otherwise("COMMON_STOCK").alias("security_type"),
        F.lit("USD").alias("currency"), F.lit("1995-01-03").cast("date").alias("first_trade_date"), F.when(F.col("s_suppkey") % 8 == 3, F.lit("1997-12-31").cast("date")).alias("delisting_date"),
        F.create_map(F.lit("synthetic"), key, F.lit("other"), F.concat(F.lit("X"), key)).alias("provider_ids"),
    )
    change = F.lit("1996-06-30").cast("date")
    old = instruments.select("instrument_id", F.concat(F.lit("OLD_"), "primary_symbol").alias("symbol"), "exchange", F.col("first_trade_date").alias("effective_from"), change.alias("effective_to"))
    new = instruments.select("instrument_id", F.concat(F.lit("NEW_"), "primary_symbol").alias("symbol"), "exchange", F.date_add(change, 1).alias("effective_from"), F.col("delisting_date").alias("effective_to"))
    return instruments, old.unionByName(new)


def instrument_master_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments and symbols, promoted twice, loaded and joined again."""
    store = ms.MasterStore(spark, shared_path(spark, "master"))
    instruments, history = supplier_master(spark, sf_dir)
    store.promote(instruments, history, "m1", "synthetic")
    store.promote(instruments.orderBy("name"), history, "m1", "synthetic")
    instruments, history = store.load("m1")
    who = instruments.select("instrument_id", F.col("provider_ids")["other"].alias("other_id"), "security_type", "delisting_date")
    return history.join(who, "instrument_id").select("instrument_id", "other_id", "security_type", "delisting_date", "symbol", "exchange", "effective_from", "effective_to")


MASTER_SQL = f"""
WITH i AS (
  SELECT {q_uuid("tsi_", DNS, "'synthetic:' || s_suppkey")} AS instrument_id, 'X' || s_suppkey AS other_id, CASE WHEN s_suppkey % 5 = 4 THEN 'ETF' ELSE 'COMMON_STOCK' END AS security_type,
         CASE WHEN s_suppkey % 8 = 3 THEN DATE '1997-12-31' END AS delisting_date, s_name, CASE WHEN s_nationkey % 2 = 0 THEN 'XNYS' ELSE 'XNAS' END AS exchange
  FROM supplier)
SELECT instrument_id, other_id, security_type, delisting_date, 'OLD_' || s_name AS symbol, exchange, DATE '1995-01-03' AS effective_from, DATE '1996-06-30' AS effective_to FROM i
UNION ALL SELECT instrument_id, other_id, security_type, delisting_date, 'NEW_' || s_name, exchange, DATE '1996-07-01', delisting_date FROM i"""


def provider_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions as a provider sends them, some twice, some without a source event, for instruments that the master may lack."""
    o = src.table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 7 == 0)
    split = F.col("o_orderkey") % 2 == 0
    rows = o.select(
        F.lit("synthetic").alias("provider_id"), (F.col("o_custkey") % 150).cast("string").alias("provider_instrument_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("source_event_id"),
        F.when(split, "split").otherwise("dividend").alias("action_type"), F.to_date("o_orderdate").alias("effective_date"),
        F.when(split, F.create_map(F.lit("ratio"), F.lit("2"))).otherwise(F.create_map(F.lit("cash"), F.lit("0.5"), F.lit("currency"), F.lit("USD"))).alias("source_fields"),
    )
    return rows.unionByName(rows.where("source_event_id % 5 = 0"))


def corporate_action_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical actions, stored and loaded, and the unresolved ones beside them."""
    instruments, _ = supplier_master(spark, sf_dir)
    records, unresolved = ms.normalise_actions(provider_actions(spark, sf_dir), instruments)
    store = ms.ActionStore(spark, shared_path(spark, "actions"))
    store.promote(records, "a1", "synthetic")
    good = store.load("a1").select("action_id", "instrument_id", "action_type", "effective_date", "source_event_id", F.col("source_fields")["ratio"].alias("ratio"), F.col("source_fields")["cash"].alias("cash"))
    blank = F.lit(None).cast("string")
    bad = unresolved.select(blank.alias("action_id"), F.col("provider_instrument_id").alias("instrument_id"), "action_type", "effective_date", "source_event_id", blank.alias("ratio"), blank.alias("cash"))
    return good.unionByName(bad)


ACTIONS_SQL = f"""
WITH a AS (
  SELECT CAST(o_custkey % 150 AS VARCHAR) AS pid, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS source_event_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'split' ELSE 'dividend' END AS action_type, CAST(o_orderdate AS DATE) AS effective_date
  FROM orders WHERE o_orderkey % 7 = 0),
r AS (SELECT a.*, s_suppkey IS NOT NULL AS known FROM a LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = pid),
ids AS (SELECT *, 'synthetic:' || pid || ':' || CASE WHEN source_event_id IS NOT NULL THEN 'event:' || source_event_id ELSE action_type || ':' || CAST(effective_date AS VARCHAR) END AS seed FROM r WHERE known)
SELECT DISTINCT {q_uuid("tca_", ms.ACTION_NAMESPACE, "seed")} AS action_id, {q_uuid("tsi_", DNS, "'synthetic:' || pid")} AS instrument_id, action_type, effective_date, source_event_id,
       CASE WHEN action_type = 'split' THEN '2' END AS ratio, CASE WHEN action_type = 'dividend' THEN '0.5' END AS cash
FROM ids
UNION ALL SELECT NULL, pid, action_type, effective_date, source_event_id, NULL, NULL FROM r WHERE NOT known
UNION ALL SELECT NULL, pid, action_type, effective_date, source_event_id, NULL, NULL FROM r WHERE NOT known AND CAST(source_event_id AS BIGINT) % 5 = 0"""


# ---- composite bars


def decisions(spark: SparkSession, sf_dir: str, holes: bool) -> DataFrame:
    """Evidence of two providers, adjudicated and then reviewed in bulk: lone bars stand, disagreements go to A or are rejected."""
    d = derive_bars(spark, sf_dir)
    a, b = d.where(F.dayofyear("trade_date") % 19 != 0), src.second_provider(d)
    found = ql.evidence(a, b)
    proposals = ql.adjudicate(found)
    reviews = proposals.where("decision <> 'CORROBORATED'").join(found.select(*cp.KEY, "state"), cp.KEY).select(
        "review_id",
        F.when(F.col("state") == "A_ONLY", "PRIMARY_ACCEPTED").when(F.col("state") == "B_ONLY", "SECONDARY_ACCEPTED").when(F.year("trade_date") % 2 == 0, "REJECTED").otherwise("PRIMARY_ACCEPTED").alias("decision"),
        F.concat(F.lit("seen "), F.col("state")).alias("note"),
    )
    reviewed = ql.reviewed(proposals, reviews)
    hole = lambda n, x: F.when((F.dayofyear("trade_date") % n != 0) | F.lit(not holes), x)

    def bar(df: DataFrame, name: str) -> DataFrame:
        x = F.struct(
            F.col("instrument_id").alias("provider_instrument_id"), "trade_date", "open", "high", "low", "close", "volume", hole(31, F.lit(1.0)).alias("split_factor"), hole(37, F.lit(0.0)).alias("dividend_cash"),
            F.col("open").alias("adjusted_open"), F.col("high").alias("adjusted_high"), F.col("low").alias("adjusted_low"), hole(41, F.col("close")).alias("adjusted_close"),
        )
        return df.select(*cp.KEY, x.alias(name))

    rows = reviewed.join(found.select(*cp.KEY, "state"), cp.KEY)
    return rows.join(bar(a, "a"), cp.KEY, "left").join(bar(b, "b"), cp.KEY, "left")


def _providers(spark: SparkSession, sf_dir: str, without: str = "") -> DataFrame:
    ids = src.instruments(spark, sf_dir).where(F.col("instrument_id") != without).select(F.col("instrument_id").alias("provider_instrument_id"), "instrument_id")
    return ids.withColumn("provider_id", F.explode(F.array(F.lit("A"), F.lit("B"))))


def composite_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of decisions over incomplete bars: what is included, from whom, and why not."""
    bars, origin = cp.canonicalise(decisions(spark, sf_dir, True), _providers(spark, sf_dir, "I6"), "c1")
    cp.prove(bars, origin)
    return origin.select(*cp.KEY, "included", "source_provider_id", "state", "decision", "note", F.concat_ws(",", "corroborating").alias("corroborating"), "issue")


def composite_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite bars, promoted with their provenance and loaded with the proof."""
    bars, origin = cp.canonicalise(decisions(spark, sf_dir, False), _providers(spark, sf_dir), "c1")
    store = cp.CompositeStore(spark, shared_path(spark, "composite"))
    store.promote(bars, origin, "c1")
    bars, origin = store.load("c1")
    return bars.join(origin.select(*cp.KEY, "source_provider_id"), cp.KEY).select(*cp.KEY, "close_raw", "close_split_adjusted", "provider_id", "source_provider_id", "dataset_version")


DECISIONS = """decided AS (
  SELECT *, dayofyear(trade_date) AS day, CASE state WHEN 'BOTH_AGREE' THEN 'CORROBORATED' WHEN 'A_ONLY' THEN 'PRIMARY_ACCEPTED' WHEN 'B_ONLY' THEN 'SECONDARY_ACCEPTED' ELSE CASE WHEN year(trade_date) % 2 = 0 THEN 'REJECTED' ELSE 'PRIMARY_ACCEPTED' END END AS decision
  FROM evidence)"""
SOURCED = """sourced AS (SELECT *, CASE decision WHEN 'REJECTED' THEN NULL WHEN 'SECONDARY_ACCEPTED' THEN 'B' ELSE 'A' END AS source_provider_id FROM decided)"""
CANONICAL_SQL = with_bars(
    """SELECT instrument_id, trade_date, source_provider_id IS NOT NULL AND issue IS NULL AS included, source_provider_id, state, decision, CASE WHEN state <> 'BOTH_AGREE' THEN 'seen ' || state END AS note,
       CASE state WHEN 'BOTH_AGREE' THEN 'A,B' WHEN 'A_ONLY' THEN 'A' WHEN 'B_ONLY' THEN 'B' ELSE '' END AS corroborating, issue
FROM (SELECT *, CASE WHEN source_provider_id IS NULL THEN NULL WHEN instrument_id = 'I6' THEN 'UNRESOLVED_INSTRUMENT' WHEN day % 31 = 0 THEN 'MISSING_SPLIT_FACTOR' WHEN day % 37 = 0 THEN 'MISSING_DIVIDEND' WHEN day % 41 = 0 THEN 'PARTIAL_ADJUSTED_PRICES' END AS issue FROM sourced)""",
    SECOND,
    EVIDENCE,
    DECISIONS,
    SOURCED,
)
COMPOSITE_SQL = with_bars(
    """SELECT s.instrument_id, s.trade_date, CASE source_provider_id WHEN 'A' THEN b.close ELSE c.close END AS close_raw, CASE source_provider_id WHEN 'A' THEN b.close ELSE c.close END AS close_split_adjusted,
       'composite' AS provider_id, source_provider_id, 'c1' AS dataset_version
FROM sourced s JOIN bars b USING (instrument_id, trade_date) LEFT JOIN second c USING (instrument_id, trade_date) WHERE source_provider_id IS NOT NULL""",
    SECOND,
    EVIDENCE,
    DECISIONS,
    SOURCED,
)


# ---- backfills

SPAN = ("1996-01-01", "1998-12-31")


def backfill_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill that stops after two jobs, is taken up by another run, and is loaded when whole."""
    bars = derive_bars(spark, sf_dir).select(F.col("instrument_id").alias("symbol"), "trade_date", "close", "volume", F.lit("synthetic").alias("provider_id"))

    def fetch(batches: DataFrame) -> DataFrame:
        asked = batches.select("batch_id", "window_start", "window_end", F.explode("symbols").alias("symbol"))
        return bars.join(asked, "symbol").where(F.col("trade_date").between(F.col("window_start"), F.col("window_end"))).drop("window_start", "window_end")

    path = shared_path(spark, "backfill")
    for most in (2, None):
        plan_id, batches = bf.plan(bars.select("symbol").distinct(), "synthetic", *SPAN, 90, 3)
        job = bf.Backfill(spark, path, "synthetic", plan_id, batches)
        job.run(fetch, 5, most)
    return job.load().select("symbol", "trade_date", "close", "volume", F.substring("batch_id", 1, 12).alias("batch"))


BACKFILL_RESUME_SQL = with_bars(
    f"""SELECT instrument_id AS symbol, trade_date, close, volume, 'batch-' || lpad(CAST(datediff('day', DATE '{SPAN[0]}', trade_date) // 90 * chunks + chunk + 1 AS VARCHAR), 6, '0') AS batch
FROM bars JOIN (SELECT *, (max(chunk) OVER ()) + 1 AS chunks FROM (SELECT instrument_id, (row_number() OVER (ORDER BY instrument_id) - 1) // 3 AS chunk FROM (SELECT DISTINCT instrument_id FROM bars))) USING (instrument_id)
WHERE trade_date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'"""
)


QUERIES = {
    "instrument_master_store": (instrument_master_store, MASTER_SQL),
    "corporate_action_store": (corporate_action_store, ACTIONS_SQL),
    "composite_canonical": (composite_canonical, CANONICAL_SQL),
    "composite_store": (composite_store, COMPOSITE_SQL),
    "backfill_resume": (backfill_resume, BACKFILL_RESUME_SQL),
}
