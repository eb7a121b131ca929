"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_path
from tidemark.sources.bars import derive_bars
from tidemark.streaming import incremental as inc


def stream_daily_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.run_to_end(inc.daily_bars(inc.read_events(spark, sf_dir)), "daily-bars", "update", ("event_type", "trade_date"))


DAILY_SQL = """SELECT event_type, CAST(ts AS DATE) AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n
FROM events GROUP BY 1, 2"""


def stream_pattern_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life cycle over bars that arrive in three parts."""
    path = shared_path(spark, "bars-in-order")
    inc.stage_in_order(derive_bars(spark, sf_dir), path, ["1996-01-01", "1998-01-01"])
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return inc.run_to_end(inc.lifecycle_stream(rows), "lifecycle", "append")


QUERIES = {"stream_daily_ohlc": (stream_daily_ohlc, DAILY_SQL), "stream_pattern_engine": (stream_pattern_engine, None)}
