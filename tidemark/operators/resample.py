"""Resampling of daily bars by the market's calendar: blocks of n sessions, or ISO weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def market_blocks(bars: DataFrame, sessions: int | None) -> DataFrame:
    """(trade_date, block, block_size): the union calendar of all instruments, cut into blocks.

    ``sessions`` None means ISO weeks, whose last group counts only if the last session is a Friday; else
    blocks are anchored at the first session and an incomplete tail goes. The calendar has one row a session.
    """
    days = bars.select("trade_date").distinct()
    if sessions is None:
        block = F.extract(F.lit("YEAROFWEEK"), "trade_date") * 100 + F.weekofyear("trade_date")
        marked = days.withColumn("block", block.cast("bigint"))
        sized = marked.groupBy("block").agg(F.count("*").alias("block_size"), F.max("trade_date").alias("last"))
        end = sized.agg(F.max("last").alias("end"))
        kept = sized.join(F.broadcast(end), F.lit(True)).where((F.col("last") < F.col("end")) | (F.weekday("end") == 4)).select("block", "block_size")
        return marked.join(kept, "block")
    numbered = days.withColumn("block", F.floor((F.row_number().over(Window.orderBy("trade_date")) - 1) / sessions).cast("bigint"))
    return numbered.withColumn("block_size", F.count("*").over(Window.partitionBy("block"))).where(F.col("block_size") == sessions)


def resample(bars: DataFrame, sessions: int | None) -> DataFrame:
    """Block bars: first open, extremes, last close, summed volume. An instrument that misses a session loses the block."""
    rows = bars.join(market_blocks(bars, sessions), "trade_date")
    got = rows.groupBy("instrument_id", "block").agg(
        F.count("*").alias("n"), F.first("block_size").alias("block_size"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("trade_date"),
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"), F.min("signal_index").alias("source_start"), F.max("signal_index").alias("source_end"),
    )
    return got.where(F.col("n") == F.col("block_size")).drop("n", "block_size")
