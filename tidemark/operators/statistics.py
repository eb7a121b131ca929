"""Statistics of returns: readouts, intervals, resampling by months, random controls, multiplicity.

Resampling draws come from a hash of (seed, iteration, draw), so results do not depend on partitioning or
on the order of rows; the tables that meet the iterations hold a month or an instrument a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.permutation import permuted

Z95 = 1.959963984540054


def hash_unit(*parts) -> Column:
    """A uniform number in [0, 1) from a hash of ``parts``."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def rounds(iterations: int) -> Column:
    """A row for each iteration: a literal sequence, so that no join on a constant gathers the rows in one task."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint"))).alias("iteration")


def readout(returns: DataFrame, by: list[str], r: str = "forward_return") -> DataFrame:
    """Performance of ``r`` by group: location, spread, win and loss, tails, shape, share of the best five."""
    x = F.col(r)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    n = F.count(x)
    got = returns.where(x.isNotNull()).groupBy(*by).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_samp(x).alias("sd"),
        F.avg((x > 0).cast("double")).alias("win_rate"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"),
        F.try_divide(F.avg(win), -F.avg(loss)).alias("payoff"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.min(x).alias("least"), F.percentile(x, 0.05).alias("p05"), F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.75).alias("p75"), F.percentile(x, 0.95).alias("p95"), F.max(x).alias("most"),
        F.when(n >= 3, F.skewness(x)).alias("skew"), F.when(n >= 4, F.kurtosis(x)).alias("excess_kurtosis"), F.sum(win).alias("gains"),
    )
    best = returns.where(x > 0).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(r)))).where("place <= 5").groupBy(*by).agg(F.sum(r).alias("top"))
    return got.join(best, by, "left").withColumn("top5_profit_share", F.try_divide(F.col("top"), F.col("gains"))).drop("gains", "top")


def wilson(wins: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = wins / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest((centre - spread) / scale, F.lit(0.0)), F.least((centre + spread) / scale, F.lit(1.0))


def months(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("month", F.date_format(date, "yyyy-MM"))


def month_bootstrap(monthly: DataFrame, iterations: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """2.5 % and 97.5 % quantiles of the pooled mean when months are drawn with replacement.

    ``monthly`` has (month, total, n) and the columns ``by``; an iteration draws as many months as a group
    has. Draws are rows (iteration, draw); each picks a month's number by hash and joins on it.
    """
    by = by or []
    group = Window.partitionBy(*by).orderBy("month") if by else Window.partitionBy(F.lit(1)).orderBy("month")
    numbered = monthly.withColumn("number", F.row_number().over(group) - 1)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("k"))
    draws = sizes.select("*", rounds(iterations)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)))
    draws = draws.withColumn("number", F.floor(hash_unit(F.lit(seed), "iteration", "draw") * F.col("k")).cast("int"))
    means = draws.join(numbered.select(*by, "number", "total", "n"), [*by, "number"]).groupBy(*by, "iteration").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return means.groupBy(*by).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), F.count("*").alias("iterations"))


def paired_month_bootstrap(left: DataFrame, right: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Interval of the difference of pooled means over the months that both (month, total, n) have, drawn together."""
    both = left.select("month", F.col("total").alias("t1"), F.col("n").alias("n1")).join(right.select("month", F.col("total").alias("t2"), F.col("n").alias("n2")), "month")
    numbered = both.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("month")) - 1)
    draws = numbered.agg(F.count("*").alias("k")).select("k", rounds(iterations)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)))
    draws = draws.withColumn("number", F.floor(hash_unit(F.lit(seed), "iteration", "draw") * F.col("k")).cast("int"))
    gaps = draws.join(numbered, "number").groupBy("iteration").agg((F.sum("t1") / F.sum("n1") - F.sum("t2") / F.sum("n2")).alias("gap"))
    return gaps.agg(F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"), F.avg("gap").alias("mean_gap"))


def _draw_key(seed: int, iteration: int, series: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}/{iteration}/{series}".encode(), digest_size=8).digest(), "little")


def random_timing(events: DataFrame, candidates: DataFrame, iterations: int, seed: int) -> DataFrame:
    """p of the events' mean return against means of as many random candidates of the same instruments, and the null's 95 % interval.

    Both have (instrument_id, signal_index, forward_return). Each iteration draws, for each instrument, as many of its
    candidates as it has events, without replacement: the first places of a keyed permutation. The work is iterations
    times events. An instrument with fewer candidates than events fails the job.
    """
    counts = events.where("forward_return is not null").groupBy("instrument_id").agg(F.count("*").alias("take"))
    series = candidates.where("forward_return is not null").groupBy("instrument_id").agg(F.sort_array(F.collect_list(F.struct("signal_index", "forward_return"))).alias("x"))
    chunk = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(100))).alias("first")
    pool = counts.join(series, "instrument_id", "left").select("instrument_id", "take", F.coalesce(F.col("x.forward_return"), F.array().cast("array<double>")).alias("x"), chunk)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, take = np.array(row["x"], dtype=float), row["take"]
                if len(x) < take:
                    raise ValueError(f"{row['instrument_id']} has {len(x)} candidates for {take} events")
                own = range(row["first"], min(row["first"] + 100, iterations))
                sums = [float(x[permuted(np.arange(take), len(x), _draw_key(seed, i, row["instrument_id"]))].sum()) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(sums), pa.array([take] * len(sums), pa.int64())], names=["iteration", "total", "n"])

    null = pool.repartition("instrument_id", "first").mapInArrow(draw, "iteration bigint, total double, n bigint").groupBy("iteration").agg((F.sum("total") / F.sum("n")).alias("mean"))
    observed = events.agg(F.avg("forward_return").alias("observed"), F.count("forward_return").alias("sample_size"), F.count_distinct("instrument_id").alias("instruments"))
    eligible = pool.where("first = 0").agg(F.sum(F.size("x")).cast("bigint").alias("eligible"))
    joined = null.crossJoin(F.broadcast(observed)).crossJoin(F.broadcast(eligible))  # each is one row
    rank = lambda p: F.percentile("mean", p)
    return joined.groupBy("observed", "sample_size", "instruments", "eligible").agg(
        F.avg("mean").alias("null_mean"), rank(0.025).alias("null_low"), rank(0.975).alias("null_high"),
        ((F.count_if(F.col("mean") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("iterations"),
    )


def sign_flip(differences: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Two-sided p of the mean of (month, gap) when the signs of months are flipped at random."""
    flips = differences.select("*", rounds(iterations)).withColumn("sign", F.when(hash_unit(F.lit(seed), "iteration", "month") < 0.5, -1.0).otherwise(1.0))
    means = flips.groupBy("iteration").agg(F.avg(F.col("gap") * F.col("sign")).alias("mean"), F.avg("gap").alias("observed"))
    return means.agg(F.first("observed").alias("observed"), ((F.count_if(F.abs("mean") >= F.abs("observed")) + 1) / (F.count("*") + 1)).alias("p_value"))


def adjusted(tests: DataFrame, method: str) -> DataFrame:
    """``p_adjusted`` for (hypothesis, p): none, bonferroni or benjamini_hochberg (ties by hypothesis, monotone)."""
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    if method == "none":
        return tests.withColumn("p_adjusted", F.col("p"))
    if method == "bonferroni":
        return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * m))
    if method != "benjamini_hochberg":
        raise ValueError(method)
    order = Window.partitionBy(F.lit(1)).orderBy("p", "hypothesis")
    raw = tests.withColumn("rank", F.row_number().over(order)).withColumn("raw", F.col("p") * m / F.col("rank"))
    back = Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return raw.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("raw").over(back))).drop("rank", "raw")


def neighbourhood(surface: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Per cell: neighbours (rank distance at most 1 on each axis), their share above zero, and the best of them."""
    ranked = surface
    for a in axes:
        ranked = ranked.withColumn(f"{a}_rank", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(a)))
    other = ranked.select(*[F.col(f"{a}_rank").alias(f"{a}_other") for a in axes], F.col(value).alias("near"))
    offsets = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    reach = ranked
    for a in axes:  # equi-join on shifted ranks instead of a band join
        reach = reach.withColumn("shift", offsets).withColumn(f"{a}_other", F.col(f"{a}_rank") + F.col("shift")).drop("shift")
    reach = reach.where(" or ".join(f"{a}_other <> {a}_rank" for a in axes))
    return reach.join(other, [f"{a}_other" for a in axes]).groupBy(*axes).agg(F.count("near").alias("neighbours"), F.avg((F.col("near") > 0).cast("double")).alias("positive_fraction"), F.max("near").alias("best_neighbour"))


# Shapes of a response, and the shares of its spread that count as flat and as near the best.
INCREASING, DECREASING, MIXED, INSUFFICIENT = "increasing", "decreasing", "mixed", "insufficient"
FLAT, NEAR, NEAR_LEAST = 0.08, 0.12, 0.005


def response_shape(points: DataFrame, by: list[str], value: str, expectancy: str) -> DataFrame:
    """How ``expectancy`` answers to ``value`` in each group ``by``: its shape, the best cell, the plateau around it and the range to test next.

    Cells without an expectancy do not count, and fewer than three tell nothing. Most steps up (within a tolerance) and a
    last cell clearly over the first make an increasing response, likewise decreasing; others are mixed. The plateau is
    the run of cells near the best one that holds it: gaps and islands over the cells in order. The next range goes on outward
    where the best cell is the end of a clear slope, else from one neighbour of the best cell to the other.
    """
    v, e = F.col(value).cast("double"), F.col(expectancy)
    every, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("v")
    rows = points.where(e.isNotNull()).select(*by, v.alias("v"), e.alias("e"))
    rows = rows.withColumn("diff", F.col("e") - F.lag("e").over(order)).withColumn("step", F.col("v") - F.lag("v").over(order)).withColumn("below", F.coalesce(F.lag("v").over(order), "v")).withColumn("above", F.coalesce(F.lead("v").over(order), "v"))
    rows = rows.withColumn("spread", F.max("e").over(every) - F.min("e").over(every)).withColumn("best", F.max("e").over(every))
    rows = rows.withColumn("flat", F.greatest(F.lit(1e-12), F.col("spread") * FLAT)).withColumn("near", F.col("e") >= F.col("best") - F.greatest(F.lit(NEAR_LEAST), F.col("spread") * NEAR))
    rows = rows.withColumn("island", F.sum((~F.col("near")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("home", F.min_by("island", F.struct(-F.col("e"), F.col("v"))).over(every)).withColumn("on", F.col("near") & (F.col("island") == F.col("home")))
    got = rows.groupBy(*by).agg(
        F.count("*").alias("cells"), F.count_if(F.col("diff") >= -F.col("flat")).alias("rising"), F.count_if(F.col("diff") <= F.col("flat")).alias("falling"), F.min_by("e", "v").alias("e0"), F.max_by("e", "v").alias("e1"), F.max("flat").alias("flat"),
        F.min("v").alias("first"), F.max("v").alias("last"), F.min_by(F.struct("v", "e", "below", "above"), F.struct(-F.col("e"), F.col("v"))).alias("top"), F.percentile("step", 0.5).alias("step"),
        F.min(F.when(F.col("on"), F.col("v"))).alias("plateau_low"), F.max(F.when(F.col("on"), F.col("v"))).alias("plateau_high"), F.count_if(F.col("on")).alias("plateau_cells"),
    )
    most = F.greatest(F.lit(1), F.floor((4 * (F.col("cells") - 1) + 4) / 5))
    shape = F.when(F.col("cells") < 3, INSUFFICIENT).when((F.col("rising") >= most) & (F.col("e1") > F.col("e0") + F.col("flat")), INCREASING).when((F.col("falling") >= most) & (F.col("e1") < F.col("e0") - F.col("flat")), DECREASING).otherwise(MIXED)
    got = got.withColumn("shape", shape).withColumn("reach", F.greatest(F.greatest(F.col("last") - F.col("first"), 4 * F.col("step")), 5 * F.col("step")))
    out, back = (F.col("shape") == INCREASING) & (F.col("top.v") == F.col("last")), (F.col("shape") == DECREASING) & (F.col("top.v") == F.col("first"))
    known = F.col("cells") >= 3
    low = F.when(out, F.col("last")).when(back, F.greatest(F.lit(0.0), F.col("first") - F.col("reach"))).otherwise(F.col("top.below"))
    high = F.when(out, F.col("last") + F.col("reach")).when(back, F.col("first")).otherwise(F.col("top.above"))
    told = lambda c: F.when(known, c)
    return got.select(*by, "cells", "shape", told(F.col("top.v")).alias("best_value"), told(F.col("top.e")).alias("best_expectancy"), *[told(F.col(c)).alias(c) for c in ("plateau_low", "plateau_high", "plateau_cells")], told(low).alias("next_low"), told(high).alias("next_high"))


def walk_forward(boundaries: list[str]) -> list[tuple[int, str, str, str, str]]:
    """Expanding folds from N boundaries: (fold, train_start, train_end, test_start, test_end), N - 2 of them."""
    if len(boundaries) < 3 or sorted(set(boundaries)) != list(boundaries):
        raise ValueError("at least three rising boundaries")
    return [(i, boundaries[0], boundaries[i], boundaries[i], boundaries[i + 1]) for i in range(1, len(boundaries) - 1)]


# The verdicts in the order of their rules.
VERDICTS = ("INSUFFICIENT_SAMPLE", "NO_EDGE_VS_SIMPLE_BASELINE", "NOT_DISTINGUISHABLE_FROM_RANDOM_TIMING", "RAW_EDGE_UNCERTAIN", "PARAMETER_REGION_UNSTABLE", "PRELIMINARY_EDGE")


def verdict(n: Column, excess: Column, p: Column, beyond_null: Column, low: Column, neighbours: Column) -> Column:
    """The first rule that fails names the verdict; an unknown interval fails its rule, an unknown excess or neighbourhood does not."""
    unclear = F.coalesce(low <= 0, F.lit(True))
    return F.when(n < 30, VERDICTS[0]).when(excess <= 0, VERDICTS[1]).when((beyond_null <= 0) | (p >= 0.05), VERDICTS[2]).when(unclear, VERDICTS[3]).when(neighbours < 0.5, VERDICTS[4]).otherwise(VERDICTS[5])
