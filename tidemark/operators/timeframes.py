"""Patterns on block bars, outcomes on daily bars: signals of a block go to the last session of the block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import outcomes as oc
from tidemark.operators import patterns as pt
from tidemark.operators.resample import market_blocks

# Quality states from the best to the worst.
QUALITY = ("PASS", "WARN", "QUARANTINE", "REJECT")
EVENT_VERSION = "consolidation-close-breakout-timeframe-v0.1"


def block_bars(bars: DataFrame, sessions: int | None) -> DataFrame:
    """Block bars with all that patterns need, their own ``signal_index``, and the daily positions ``source_start`` and ``source_end``.

    A block bar is eligible if all its days are, and has the worst quality of them. An instrument that misses a
    session of a block has no bar for it. ``sessions`` as in :func:`market_blocks`. A block of several dataset versions fails.
    """
    rows = bars.join(market_blocks(bars, sessions), "trade_date")
    order = F.array(*[F.lit(q) for q in QUALITY])
    first, last = lambda c: F.min_by(c, "trade_date").alias(c), lambda c: F.max_by(c, "trade_date").alias(c)
    version = F.when(F.min("dataset_version") != F.max("dataset_version"), F.raise_error(F.lit("a block of several dataset versions"))).otherwise(F.min("dataset_version"))
    got = rows.groupBy("instrument_id", "block").agg(
        F.count("*").alias("n"), F.first("block_size").alias("block_size"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("end_date"),
        first("open"), first("oc"), F.max("high").alias("high"), F.max("hc").alias("hc"), F.min("low").alias("low"), F.min("lc").alias("lc"), last("close"), last("cc"), F.sum("volume").alias("volume"),
        F.min("eligibility").alias("eligibility"), F.max(F.array_position(order, F.col("quality_status"))).cast("int").alias("worst"), version.alias("dataset_version"),
        F.min("signal_index").alias("source_start"), F.max("signal_index").alias("source_end"),
    ).where(F.col("n") == F.col("block_size"))
    position = F.row_number().over(Window.partitionBy("instrument_id").orderBy("end_date")) - 1
    return got.withColumn("quality_status", order[F.col("worst") - 1]).withColumn("signal_index", position).withColumnRenamed("end_date", "trade_date").drop("n", "block_size", "worst")


def to_daily(rows: DataFrame, bars: DataFrame, name: str) -> DataFrame:
    """Events (instrument_id, trade_date, block_index, ...) at daily positions: the last bar of the instrument up to the event's day.

    The position comes from a merge of events and bars in the order of days, the last known value; an event before the first bar fails.
    Ids say which time frame they are of.
    """
    both = bars.select("instrument_id", "trade_date", F.col("signal_index").alias("_at"), F.lit(0).alias("_kind")).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("instrument_id").orderBy("trade_date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_last", F.last("_at", True).over(upto)).where("_kind = 1")
    daily = F.when(F.col("_last").isNull(), F.raise_error(F.lit("an event before the first bar")).cast("int")).otherwise(F.col("_last"))
    event_id = F.concat_ws(":", "instrument_id", F.col("trade_date").cast("string"), F.lit(f"pattern_timeframe={name}"))
    return placed.withColumn("signal_index", daily).withColumn("event_id", event_id).withColumn("event_definition_version", F.lit(EVENT_VERSION)).drop("_at", "_kind", "_last")


def events(blocks: DataFrame, bars: DataFrame, name: str, duration: int, max_range: float, trend: str = "NONE", cooldown: int = 5) -> DataFrame:
    """Breakouts on block bars, at daily positions, with the block's position as ``block_index``."""
    hits = pt.breakouts(blocks, duration, max_range, trend, cooldown).select("instrument_id", "trade_date", F.col("signal_index").alias("block_index"))
    return to_daily(hits, bars, name)


def report(bars: DataFrame, frames: dict[str, int | None], horizons: Sequence[int] = (5, 10, 20, 40, 60), duration: int = 10, max_range: float = 0.12, trend: str = "NONE", cooldown: int = 5, gap: int = 5) -> DataFrame:
    """Per time frame and horizon: events, their outcomes in daily sessions, the baseline of every ``gap``-th block bar in the same trend, breadth and concentration."""
    out = None
    for name, sessions in frames.items():
        blocks = block_bars(bars, sessions)
        found = events(blocks, bars, name, duration, max_range, trend, cooldown).select("instrument_id", "signal_index", "trade_date")
        done = oc.outcome_paths(found, bars, tuple(horizons)).where(F.col("status") == oc.COMPLETE)
        own = done.groupBy("horizon").agg(F.count("*").alias("complete"), F.avg("forward_return").alias("mean_return"), F.percentile("forward_return", 0.5).alias("median_return"), F.avg((F.col("forward_return") > 0).cast("double")).alias("positive_fraction"))
        signals = pt.with_trends(blocks).where(pt.trend_ok(trend)).select("instrument_id", F.col("signal_index").alias("block_index"), F.col("source_end").alias("signal_index"))
        usual = None
        for h in horizons:
            one = oc.baseline(bars, signals, (h,), gap, "path", "block_index").groupBy("horizon").agg(F.count("*").alias("baseline_n"), F.avg("forward_return").alias("baseline_mean"))
            usual = one if usual is None else usual.unionByName(one)
        per = found.groupBy("instrument_id").agg(F.count("*").alias("n"))
        top = F.aggregate(F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 5), F.lit(0).cast("long"), lambda a, x: a + x)  # one number an instrument
        size = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("with_events"), top.alias("top")).crossJoin(F.broadcast(bars.agg(F.count_distinct("instrument_id").alias("instruments"))))
        months = found.agg(F.count_distinct(F.date_format("trade_date", "yyyy-MM")).alias("active_months"))
        every = bars.sparkSession.createDataFrame([(h,) for h in horizons], "horizon int")
        row = every.join(own, "horizon", "left").join(usual, "horizon", "left").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(months)).withColumn("timeframe", F.lit(name))  # facts of one row each
        out = row if out is None else out.unionByName(row)
    return out.select(
        "timeframe", "horizon", "events", F.coalesce("complete", F.lit(0)).alias("complete"), "mean_return", "median_return", "positive_fraction", F.coalesce("baseline_n", F.lit(0)).alias("baseline_n"), "baseline_mean",
        (F.col("mean_return") - F.col("baseline_mean")).alias("excess"), (F.col("with_events") / F.col("instruments")).alias("breadth"), F.try_divide(F.col("top"), F.col("events")).alias("top5_share"), "active_months",
    )
