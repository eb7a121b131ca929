"""Stops, targets and trailing exits of events: static levels hit first, and running maxima for trailing ones.

A trailing stop is monotone in the running peak of the bars *before* the current one, so its level at each
offset is a window maximum, and the exit is the first offset at which a level is touched: no recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.outcomes import EVENT_KEY, path_rows

#: Policy rows: (policy_id, stop_pct, trail_pct, target_pct); null leaves a part out.
POLICY_SCHEMA = "policy_id string, stop_pct double, trail_pct double, target_pct double"
POLICIES = (
    ("hold", None, None, None),
    *((f"stop_{p}", p / 100, None, None) for p in (2, 5, 10)),
    *((f"trail_{p}", None, p / 100, None) for p in (3, 5, 10)),
    ("stop_5_target_10", 0.05, None, 0.10),
    ("trail_5_target_10", None, 0.05, 0.10),
)


def cost_adjusted(entry: Column, out: Column, slippage_bps: float = 0.0, commission_bps: float = 0.0) -> Column:
    bps = (slippage_bps + commission_bps) / 1e4
    return out * (1 - bps) / (entry * (1 + bps)) - 1


def exit_results(events: DataFrame, bars: DataFrame, horizon: int, policies: Sequence[tuple] = POLICIES, stop_first: bool = True) -> DataFrame:
    """One row per event and policy over events with a complete path: exit offset, price, reason, return, MAE to exit.

    Levels are those set before a bar. An open beyond a level fills at the open; of a stop and a target in
    one bar, an open beats an intraday touch, and ``stop_first`` decides the rest (flagged ambiguous).
    The policy list is a handful of literals, so its rows are joined by broadcast.
    """
    spark = events.sparkSession
    rows = path_rows(events, bars, horizon)
    whole = Window.partitionBy(*EVENT_KEY)
    rows = rows.withColumn("n", F.max("offset").over(whole)).where(F.col("n") == horizon)
    table = spark.createDataFrame(list(policies), POLICY_SCHEMA)
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(table.withColumn("one", F.lit(1))), "one").drop("one")
    fixed = F.col("entry") * (1 - F.col("stop_pct"))
    trail = F.col("peak_before") * (1 - F.col("trail_pct"))
    rows = rows.withColumn("stop", F.coalesce(F.greatest(fixed, trail), fixed, trail)).withColumn("target", F.col("entry") * (1 + F.col("target_pct")))
    stop_open, stop_bar = F.coalesce(F.col("open") <= F.col("stop"), F.lit(False)), F.coalesce(F.col("low") <= F.col("stop"), F.lit(False))
    goal_open, goal_bar = F.coalesce(F.col("open") >= F.col("target"), F.lit(False)), F.coalesce(F.col("high") >= F.col("target"), F.lit(False))
    first, second = ("STOP", stop_bar, F.col("stop")), ("TARGET", goal_bar, F.col("target"))
    if not stop_first:
        first, second = second, first
    reason = F.when(stop_open, "STOP").when(goal_open, "TARGET").when(first[1], first[0]).when(second[1], second[0]).when(F.col("offset") == horizon, "HORIZON")
    price = F.when(stop_open | goal_open, F.col("open")).when(first[1], first[2]).when(second[1], second[2]).otherwise(F.col("close"))
    rows = rows.withColumn("reason", reason).withColumn("price", price).withColumn("both", stop_bar & goal_bar & ~stop_open & ~goal_open)
    until = Window.partitionBy(*EVENT_KEY, "policy_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("low_most", F.min("low").over(until))
    hit = F.struct("reason", "price", "both", "low_most", "bar_date")
    chosen = rows.where("reason is not null").groupBy(*EVENT_KEY, "policy_id", "signal_date").agg(F.first("entry").alias("entry"), F.min("offset").alias("exit_offset"), F.min_by(hit, "offset").alias("x"))
    return chosen.select(
        *EVENT_KEY, "signal_date", "policy_id", "entry", "exit_offset",
        F.col("x.bar_date").alias("exit_date"), F.col("x.reason").alias("reason"), F.col("x.price").alias("exit_price"), F.col("x.both").alias("ambiguous"),
        cost_adjusted(F.col("entry"), F.col("x.price")).alias("net_return"),
        (F.col("x.low_most") / F.col("entry") - 1).alias("mae_to_exit"),
    )


def exit_summary(results: DataFrame) -> DataFrame:
    """Per policy: counts and rates, expectancy and its gap to holding, win rate, payoff, profit factor, tails."""
    r = F.col("net_return")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    got = results.groupBy("policy_id").agg(
        F.count("*").alias("n"),
        F.avg((F.col("reason") == "STOP").cast("double")).alias("stop_rate"),
        F.avg((F.col("reason") == "TARGET").cast("double")).alias("target_rate"),
        F.avg(F.col("ambiguous").cast("double")).alias("ambiguous_rate"),
        F.avg(r).alias("expectancy"),
        F.percentile(r, 0.5).alias("median_return"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.try_divide(F.avg(win), -F.avg(loss)).alias("payoff"),
        F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.percentile(r, 0.05).alias("p05"),
        F.avg("exit_offset").alias("holding_bars"),
        F.percentile("mae_to_exit", 0.5).alias("median_mae"),
    )
    hold = got.where("policy_id = 'hold'").select(F.col("expectancy").alias("hold_expectancy"))
    return got.withColumn("one", F.lit(1)).join(F.broadcast(hold.withColumn("one", F.lit(1))), "one", "left").withColumn("delta_vs_hold", F.col("expectancy") - F.col("hold_expectancy")).drop("one", "hold_expectancy")


def premature_stops(results: DataFrame, outcomes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per policy: stopped events, and those whose return at the horizon would have been above ``threshold``."""
    held = outcomes.select(*EVENT_KEY, "forward_return")
    stopped = results.where("reason = 'STOP'").join(held, list(EVENT_KEY))
    return stopped.groupBy("policy_id").agg(F.count("*").alias("stopped"), F.count_if(F.col("forward_return") > threshold).alias("premature"))
