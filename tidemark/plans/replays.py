"""Queries of scans replayed over past dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import patterns as pt
from tidemark.operators import replay as rp
from tidemark.sources import bars as src
from tidemark.sources.bars import FLAWED, derive_bars, flawed, with_bars


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with unusable days, and one instrument whose early bars are of another dataset."""
    early = (F.col("instrument_id") == "I7") & (F.col("trade_date") < F.lit("1997-01-01").cast("date"))
    return flawed(derive_bars(spark, sf_dir)).withColumn("dataset_version", F.when(early, "older").otherwise(F.col("dataset_version")))


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All instruments, and one that has no bars, on the first session of each month; one loses its symbol for a time."""
    bars = _bars(spark, sf_dir)
    dates = bars.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min("trade_date").alias("as_of")).select("as_of")
    every = src.instruments(spark, sf_dir).select("instrument_id").unionByName(spark.range(1).select(F.lit("none").alias("instrument_id")))
    requests = dates.select("as_of", F.lit(1).alias("one")).join(F.broadcast(every.withColumn("one", F.lit(1))), "one").drop("one")  # a row an instrument and date is the result
    at = lambda x: F.lit(x).cast("date")
    symbols = every.select("instrument_id", F.concat(F.lit("S"), "instrument_id").alias("symbol"), at("1990-01-01").alias("effective_from"), F.when(F.col("instrument_id") == "I5", at("1996-12-31")).alias("effective_to"))
    symbols = symbols.unionByName(symbols.where("instrument_id = 'I5'").select("instrument_id", F.lit("T").alias("symbol"), at("1998-01-01").alias("effective_from"), F.lit(None).cast("date").alias("effective_to")))
    return rp.replay(bars, rp.change_intervals(pt.lifecycle_states(bars)), requests, symbols, "tpch-v1", "u1")


def replay_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replays say of each instrument, without the states."""
    return _replayed(spark, sf_dir).select("as_of", "instrument_id", "status", "latest_date", "symbol")


STATUS_SQL = with_bars(
    """SELECT as_of, instrument_id, CASE WHEN latest_date IS NULL THEN 'BLOCKED_MISSING_HISTORY' WHEN instrument_id = 'I7' AND latest_date < DATE '1997-01-01' THEN 'BLOCKED_DATASET_MISMATCH' WHEN latest_date < as_of THEN 'BLOCKED_MISSING_AS_OF_SESSION'
  WHEN NOT usable THEN 'BLOCKED_QUALITY' WHEN symbol IS NULL THEN 'BLOCKED_MISSING_SYMBOL' ELSE 'EVALUATED' END AS status, latest_date, symbol
FROM (SELECT as_of, r.instrument_id, trade_date AS latest_date, usable, CASE WHEN r.instrument_id <> 'I5' OR as_of <= DATE '1996-12-31' THEN 'S' || r.instrument_id WHEN as_of >= DATE '1998-01-01' THEN 'T' END AS symbol
  FROM (SELECT as_of, instrument_id FROM (SELECT min(trade_date) AS as_of FROM bars GROUP BY date_trunc('month', trade_date)), (SELECT DISTINCT concat('I', CAST(s_suppkey % 8 AS VARCHAR)) AS instrument_id FROM supplier UNION ALL SELECT 'none')) r
  ASOF LEFT JOIN flawed f ON f.instrument_id = r.instrument_id AND f.trade_date <= r.as_of)""",
    FLAWED,
)


def scanner_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a date: statuses, candidates by state, checksum."""
    return rp.replay_summary(_replayed(spark, sf_dir))


QUERIES = {"replay_statuses": (replay_statuses, STATUS_SQL), "scanner_replay": (scanner_replay, None)}
