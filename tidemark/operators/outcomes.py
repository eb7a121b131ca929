"""Forward outcomes of events: path from the next open, excursions, drawdown bounds, gaps, summaries.

An event is joined to its path by (instrument, position), one row per event and offset, so the join is an
equi-join whatever the horizon. Statistics of a path are ordered aggregates of those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# What an outcome can be.
COMPLETE, NO_ENTRY, ENTRY_UNUSABLE = "COMPLETE", "NO_ENTRY_BAR", "ENTRY_UNUSABLE"
CUT_BY_BAR, CUT_BY_END = "TRUNCATED_UNUSABLE_BAR", "TRUNCATED_END_OF_DATA"
EVENT_KEY = ("instrument_id", "signal_index")


def usable():
    return F.col("eligibility") & (F.col("quality_status") == "PASS")


def walked(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Bars at offsets 1..horizon behind each event, usable or not; ``gap`` is the open against the close of the bar before."""
    steps = events.select(*EVENT_KEY, F.col("trade_date").alias("signal_date"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("offset"))
    steps = steps.withColumn("at", F.col("signal_index") + F.col("offset"))
    last_close = F.lag("close").over(Window.partitionBy("instrument_id").orderBy("signal_index"))
    path = bars.select("instrument_id", F.col("signal_index").alias("at"), F.col("trade_date").alias("bar_date"), "open", "high", "low", "close", (F.col("open") / last_close - 1).alias("gap"), usable().alias("ok"))
    return steps.join(path, ["instrument_id", "at"])


def path_rows(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Bars at offsets 1..horizon behind each event up to the first that is not usable, with running peaks: the longest path, for all horizons."""
    so_far = Window.partitionBy(*EVENT_KEY).orderBy("offset")
    joined = walked(events, bars, horizon).withColumn("clean", F.min(F.col("ok").cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    joined = joined.where("clean").withColumn("entry", F.first("open").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    past = so_far.rowsBetween(Window.unboundedPreceding, -1)
    peak_before = F.coalesce(F.greatest(F.max("high").over(past), F.col("entry")), F.col("entry"))
    return joined.withColumn("peak_before", peak_before).withColumn("peak_with", F.greatest("peak_before", "high"))


def outcome_paths(events: DataFrame, bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per event and horizon: entry, returns, MFE and MAE with first offsets, drawdown bounds, gaps, status.

    A path ends before the first unusable bar or with the data. An event without a next bar is NO_ENTRY_BAR, one whose
    next bar is not usable ENTRY_UNUSABLE; both keep a row. Gaps include the one into the entry. Ties go to the earliest bar.
    """
    rows = path_rows(events, bars, max(horizons))
    wanted = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    spread = rows.select("*", wanted).where(F.col("offset") <= F.col("horizon"))
    stats = spread.groupBy(*EVENT_KEY, "horizon").agg(
        F.first("entry").alias("entry"),
        F.max("offset").alias("bars_seen"),
        F.max_by("close", "offset").alias("exit_close"),
        F.max("high").alias("high_most"),
        F.max_by("offset", F.struct("high", -F.col("offset"))).alias("mfe_offset"),
        F.min("low").alias("low_most"),
        F.min_by("offset", F.struct("low", "offset")).alias("mae_offset"),
        F.min(F.col("low") / F.col("peak_before") - 1).alias("drawdown_upper"),
        F.min(F.col("low") / F.col("peak_with") - 1).alias("drawdown_lower"),
        F.coalesce(F.greatest(F.max("gap"), F.lit(0.0)), F.lit(0.0)).alias("gap_up"),
        F.coalesce(F.least(F.min("gap"), F.lit(0.0)), F.lit(0.0)).alias("gap_down"),
        F.min_by("gap", "offset").alias("entry_gap"),
        F.max_by(F.when(F.col("gap") > 0, F.col("bar_date")), F.struct(F.greatest("gap", F.lit(0.0)), -F.col("offset"))).alias("gap_up_date"),
        F.min_by(F.when(F.col("gap") < 0, F.col("bar_date")), F.struct(F.least("gap", F.lit(0.0)), "offset")).alias("gap_down_date"),
    )
    flaws = walked(events, bars, max(horizons)).where(~F.col("ok")).groupBy(*EVENT_KEY).agg(F.min("offset").alias("bad"), F.min_by("bar_date", "offset").alias("bad_date"))
    keys = events.select(*EVENT_KEY, F.col("trade_date").alias("signal_date"), wanted)
    out = keys.join(stats, [*EVENT_KEY, "horizon"], "left").join(flaws, list(EVENT_KEY), "left")
    cut = F.col("bad") <= F.col("horizon")
    complete = F.col("bars_seen") == F.col("horizon")
    change = F.col("exit_close") / F.col("entry") - 1
    return out.select(
        *EVENT_KEY, "signal_date", "horizon", "entry",
        F.when(F.col("bad") == 1, ENTRY_UNUSABLE).when(F.col("entry").isNull(), NO_ENTRY).when(complete, COMPLETE).when(cut, CUT_BY_BAR).otherwise(CUT_BY_END).alias("status"),
        F.coalesce("bars_seen", F.lit(0)).alias("observed"), F.when(cut, F.col("bad_date")).alias("truncated_on"),
        F.when(complete, change).alias("forward_return"),
        change.alias("partial_return"),
        (F.col("high_most") / F.col("entry") - 1).alias("mfe"), "mfe_offset",
        (F.col("low_most") / F.col("entry") - 1).alias("mae"), "mae_offset",
        F.when(F.col("mfe_offset") < F.col("mae_offset"), "MFE_FIRST").when(F.col("mfe_offset") > F.col("mae_offset"), "MAE_FIRST").when(F.col("mfe_offset").isNotNull(), "AMBIGUOUS").alias("first_extreme"),
        "drawdown_upper", "drawdown_lower",
        F.when(F.col("drawdown_upper").isNotNull(), F.abs(F.col("drawdown_upper") - F.col("drawdown_lower")) > 1e-15).alias("drawdown_ambiguous"),
        "gap_up", "gap_down", "entry_gap", "gap_up_date", "gap_down_date",
    )


def outcome_summary(outcomes: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Per horizon: count, mean, median, positive share, quartiles, median MFE and MAE of complete outcomes."""
    spark = outcomes.sparkSession
    done = outcomes.where(F.col("status") == COMPLETE)
    q = lambda x, p: F.percentile(x, p)
    got = done.groupBy("horizon").agg(
        F.count("*").alias("n"),
        F.avg("forward_return").alias("mean_return"),
        q("forward_return", 0.5).alias("median_return"),
        F.avg((F.col("forward_return") > 0).cast("double")).alias("positive_fraction"),
        q("forward_return", 0.25).alias("p25"),
        q("forward_return", 0.75).alias("p75"),
        q("mfe", 0.5).alias("median_mfe"),
        q("mae", 0.5).alias("median_mae"),
    )
    every = spark.createDataFrame([(h,) for h in horizons], "horizon int")
    return every.join(got, "horizon", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def taken(positions: np.ndarray, gap: int) -> np.ndarray:
    """The first of the sorted ``positions``, then each next one that lies ``gap`` or more after the last taken."""
    out, at = [], 0
    while at < len(positions):
        out.append(positions[at])
        at = int(np.searchsorted(positions, positions[at] + gap, side="left"))
    return np.array(out, dtype=np.int64)


def stride(candidates: DataFrame, gap: int, strict: bool = False, by: Sequence[str] = ("instrument_id",), position: str = "signal_index") -> DataFrame:
    """Greedy thinning in series order: take a row, then skip until ``gap`` positions later (``strict``: more than that).

    ``row_number % gap`` would be another thing. A series ``by`` goes once through a kernel, its positions alone, in
    linear work; which rows are candidates, and whether they stand by their own position or by that of a block bar,
    is the caller's choice.
    """
    by, step = list(by), max(1, gap + 1 if strict else gap)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = taken(np.unique(rows["_p"].to_numpy()), step)
        return pa.table([pa.array([k.as_py()] * len(found), k.type) for k in key] + [pa.array(found)], names=[*by, "_p"])

    series = candidates.select(*by, F.col(position).cast("bigint").alias("_p"))
    schema = StructType([*series.select(*by).schema.fields, StructField("_p", LongType())])
    kept = series.groupBy(*by).applyInArrow(run, schema).withColumnRenamed("_p", position)
    return candidates.join(kept, [*by, position])


#: Which candidates the thinning of a baseline sees: those with a usable entry bar, or those with a whole usable path.
NEEDS = ("entry", "path")


def baseline(bars: DataFrame, signals: DataFrame, horizons: Sequence[int], gap: int = 5, need: str = "entry", position: str = "signal_index") -> DataFrame:
    """(instrument_id, signal_index, horizon, forward_return) of ``signals`` (instrument_id, signal_index, ...) taken every ``gap`` positions.

    Entry is the next open, exit the close ``horizon`` bars on; a path with an unusable bar, or past the end, gives no
    return. With ``need`` "entry" the thinning runs over signals whose own and next bar are usable, and paths are looked at
    later; with "path" only signals with a whole path of the one horizon count. ``position`` is the column that the gap is
    counted in, so signals of block bars can be thinned by blocks and measured by days.
    """
    if need not in NEEDS or (need == "path" and len(horizons) != 1):
        raise ValueError("a baseline needs an entry, or the path of one horizon")
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    ok = (F.col("eligibility") & (F.col("quality_status") == "PASS")).cast("int")
    rows = bars.select("instrument_id", "trade_date", "signal_index", "close", ok.alias("ok"), F.lead("open", 1).over(w).alias("entry"), F.lead(ok, 1).over(w).alias("next_ok"))
    for h in horizons:
        ahead = w.rowsBetween(1, h)
        rows = rows.withColumn(f"r_{h}", F.when((F.count("ok").over(ahead) == h) & (F.min("ok").over(ahead) == 1), F.lead("close", h).over(w) / F.col("entry") - 1))
    rows = rows.join(signals.select("instrument_id", "signal_index", *[c for c in (position,) if c != "signal_index"]), ["instrument_id", "signal_index"])
    rows = rows.where((F.col("ok") == 1) & (F.col("next_ok") == 1))
    if need == "path":
        rows = rows.where(F.col(f"r_{horizons[0]}").isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r_{h}").alias("forward_return")) for h in horizons])).alias("x")
    return stride(rows, gap, position=position).select("instrument_id", "signal_index", pairs).select("instrument_id", "signal_index", "x.*").where("forward_return is not null")
