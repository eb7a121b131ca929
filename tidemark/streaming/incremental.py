"""Structured Streaming: daily bars from events, and the pattern life cycle bar by bar."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.patterns import STATE_SCHEMA, Lifecycle, Tracker, run_tracker, tracker_input
from tidemark.session import shared_path

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def daily_bars(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Tumbling one-day windows per event type: open, extremes, close, count, under a watermark."""
    at = F.struct("ts", "event_id")
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n"))
        .select("event_type", F.to_date("w.start").alias("trade_date"), "open", "high", "low", "close", "n")
    )


def run_to_end(stream: DataFrame, name: str, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Process all that is there, in micro-batches, into a folder, and read it.

    A batch writes a folder of its own number, so one that is run again replaces what it wrote before. In update
    mode a row replaces earlier ones of its ``keys``: only open windows are state, closed ones lie in the folder.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(out)
    if mode != "update":
        return got.drop("batch")
    rest = [c for c in got.columns if c not in (*keys, "batch")]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def lifecycle_stream(inputs: DataFrame, settings: Lifecycle | None = None) -> DataFrame:
    """States of bars that arrive in order; the state of an instrument is its tracker's, kept as JSON.

    ``inputs`` is a stream of :func:`tracker_input` rows. A bar older than the last of its instrument fails.
    """
    settings = settings or Lifecycle()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(settings, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames), ignore_index=True)
        out = run_tracker(tracker, rows)
        state.update((json.dumps(tracker.state, default=int),))
        yield out

    return inputs.groupBy("instrument_id").applyInPandasWithState(step, STATE_SCHEMA, "saved string", "append", GroupStateTimeout.NoTimeout)


def stage_in_order(bars: DataFrame, path: str, cuts: list[str], settings: Lifecycle | None = None) -> None:
    """Write tracker rows to ``path`` in date order, one file a range, for a stream to read."""
    rows = tracker_input(bars, settings or Lifecycle())
    edges = [None, *cuts, None]
    for a, b in zip(edges, edges[1:], strict=False):
        part = rows
        if a:
            part = part.where(F.col("trade_date") >= F.lit(a).cast("date"))
        if b:
            part = part.where(F.col("trade_date") < F.lit(b).cast("date"))
        part.repartition("instrument_id").write.mode("append").parquet(path)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parque*")
