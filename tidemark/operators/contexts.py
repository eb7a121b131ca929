"""Structural contexts of events: what was known of the base before its signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = ("formation_start", "formation_end", "support", "resistance")


def with_context(events: DataFrame, contexts: DataFrame, bars: DataFrame | None = None, duration: int | None = None) -> DataFrame:
    """``events`` with formation_start, formation_end, support and resistance, and ``context``: SUPPLIED, FORMATION or NONE.

    ``events`` has (event_id, instrument_id, signal_index, trade_date, dataset_version), ``contexts`` (event_id, dataset_version and
    the four). A context is fixed before its signal and of the event's dataset, and an event has one at most: others fail
    the job. With ``bars`` and ``duration`` an event without a context takes the bars of its formation, lowest low and highest high
    of the ``duration`` bars before the signal, which must all be there; without, its context stays empty.
    """
    given = contexts.groupBy("event_id").agg(F.count("*").alias("_n"), F.min("dataset_version").alias("_version"), *[F.min(c).alias(c) for c in CONTEXT])
    rows = events.join(given, "event_id", "left")
    wrong = (
        F.when(F.col("_n") > 1, "several contexts of event ")
        .when(F.col("_n").isNotNull() & ~F.col("_version").eqNullSafe(F.col("dataset_version")), "a context of another dataset than event ")
        .when(F.col("_n").isNotNull() & ~F.coalesce(F.col("formation_end") < F.col("trade_date"), F.lit(False)), "a context that is not fixed before event ")
    )
    state = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("event_id")))).when(F.col("_n").isNotNull(), "SUPPLIED")
    rows = rows.withColumn("context", state).drop("_n", "_version")
    if bars is None or duration is None:
        return rows.withColumn("context", F.coalesce("context", F.lit("NONE")))
    before = Window.partitionBy("instrument_id").orderBy("trade_date").rowsBetween(-duration, -1)
    formed = bars.select(
        "instrument_id", "signal_index", F.count("*").over(before).alias("_bars"), F.min("trade_date").over(before).alias("_formation_start"), F.max("trade_date").over(before).alias("_formation_end"),
        F.min("low").over(before).alias("_support"), F.max("high").over(before).alias("_resistance"),
    )
    rows = rows.join(formed, ["instrument_id", "signal_index"], "left")
    short = F.raise_error(F.concat(F.lit("an incomplete formation of event "), F.col("event_id")))
    own = F.when(F.col("context").isNotNull(), F.col("context")).when(F.coalesce(F.col("_bars"), F.lit(0)) < duration, short).otherwise("FORMATION")
    filled = [F.when(F.col("context") == "SUPPLIED", F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in CONTEXT]
    return rows.withColumn("context", own).select(*events.columns, *filled, "context")
