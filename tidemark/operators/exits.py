"""Managed exits: fixed, ATR and trailing stops with targets in per cent, ATRs or R, and an order for hits in one bar.

As with initial stops, an event's bars are one array of bounded length. A trailing level follows the running peak of
the bars before, so the levels of all bars are known before the first touch is looked for, without a recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.outcomes import EVENT_KEY
from tidemark.operators.stops import Costs, event_paths

# Fixed values: (policy_id, stop family, stop size, target family, target size, whether a stop goes before a target of the same bar).
POLICIES = (
    ("hold-to-horizon", "HOLD", 0.0, "NONE", 0.0, True),
    *((f"fixed-stop-{p}pct", "FIXED_PERCENT", p / 100, "NONE", 0.0, True) for p in (2, 3, 4, 5, 7, 10)),
    *((f"atr-stop-{m:g}x", "ATR", m, "NONE", 0.0, True) for m in (1.0, 1.5, 2.0, 2.5, 3.0)),
    *((f"trailing-stop-{p}pct", "TRAILING_PERCENT", p / 100, "NONE", 0.0, True) for p in (2, 3, 5, 7, 10)),
    *((f"trailing-atr-{m:g}x", "TRAILING_ATR", m, "NONE", 0.0, True) for m in (1.0, 1.5, 2.0, 2.5, 3.0)),
    ("managed-fixed-5pct-target-2pct-stop-first", "FIXED_PERCENT", 0.05, "PERCENT", 0.02, True),
    ("managed-fixed-2pct-target-2r-target-first", "FIXED_PERCENT", 0.02, "R", 2.0, False),
    ("managed-atr-1x-target-1atr-stop-first", "ATR", 1.0, "ATR", 1.0, True),
    ("managed-atr-1x-target-1atr-target-first", "ATR", 1.0, "ATR", 1.0, False),
    ("managed-trailing-3pct-target-2r-stop-first", "TRAILING_PERCENT", 0.03, "R", 2.0, True),
)


def exit_results(events: DataFrame, bars: DataFrame, horizon: int, policies: Sequence[tuple] = POLICIES, costs: Costs = Costs()) -> DataFrame:
    """One row per event and policy, over the events with a whole path and an ATR: the same events for every policy.

    Levels are those set before a bar. An open beyond a level fills at the open and comes before a touch within
    the bar; of two of the same kind the policy's order decides, and the row is ambiguous.
    """
    names = ("policy_id", "family", "size", "goal_family", "goal_size", "stop_first")
    table = F.array(*[F.struct(*[F.lit(float(v) if k.endswith("size") else v).alias(k) for k, v in zip(names, p, strict=True)]) for p in policies])
    rows = event_paths(events, bars, horizon).where(F.col("atr").isNotNull())
    rows = rows.withColumn("entry", F.col("path")[0]["open"]).withColumn("highs", F.transform("path", lambda x: x["high"]))
    peak = lambda i: F.greatest(F.col("entry"), F.array_max(F.slice("highs", F.lit(1), i - 1)))  # noqa: E731  greatest passes over null
    rows = rows.withColumn("walk", F.transform("path", lambda x: F.struct(*[x[c].alias(c) for c in ("offset", "open", "high", "low", "close", "bar_date")], peak(x["offset"]).alias("peak"))))
    rows = rows.select("*", F.explode(table).alias("p")).select("*", "p.*").drop("p", "highs", "path")
    entry, size, atr = F.col("entry"), F.col("size"), F.col("atr")
    by_share, trailing = F.col("family").isin("FIXED_PERCENT", "TRAILING_PERCENT"), F.col("family").isin("TRAILING_PERCENT", "TRAILING_ATR")
    rows = rows.withColumn("stop", F.when(by_share, entry * (1 - size)).when(F.col("family") != "HOLD", entry - size * atr))
    goal = F.when(F.col("goal_family") == "PERCENT", entry * (1 + F.col("goal_size"))).when(F.col("goal_family") == "ATR", entry + F.col("goal_size") * atr)
    rows = rows.withColumn("goal", goal.when((F.col("goal_family") == "R") & (F.col("stop") < entry), entry + F.col("goal_size") * (entry - F.col("stop"))))

    def level(x: Column) -> Column:
        moved = F.when(F.col("family") == "TRAILING_PERCENT", x["peak"] * (1 - size)).otherwise(x["peak"] - size * atr)
        return F.when(trailing, F.greatest("stop", moved)).otherwise(F.col("stop"))

    yes = lambda c: F.coalesce(c, F.lit(False))
    marked = F.transform("walk", lambda x: F.struct(x["offset"].alias("offset"), x["open"].alias("open"), x["bar_date"].alias("bar_date"), level(x).alias("level"), yes(x["low"] <= level(x)).alias("stop_hit"), yes(x["open"] <= level(x)).alias("stop_open"), yes(x["high"] >= F.col("goal")).alias("goal_hit"), yes(x["open"] >= F.col("goal")).alias("goal_open")))
    rows = rows.withColumn("hit", F.get(F.filter(marked, lambda x: x["stop_hit"] | x["stop_open"] | x["goal_hit"] | x["goal_open"]), F.lit(0)))
    h = lambda c: F.col(f"hit.{c}")
    stop_any, goal_any = h("stop_hit") | h("stop_open"), h("goal_hit") | h("goal_open")
    alike = stop_any & goal_any & (h("stop_open") == h("goal_open"))
    rows = rows.withColumn("ambiguous", yes(alike)).withColumn("stopped", yes(F.when(alike, F.col("stop_first")).otherwise(stop_any & (~goal_any | h("stop_open")))))
    rows = rows.withColumn("reason", F.when(F.col("stopped"), "STOP").when(F.col("hit").isNotNull(), "TARGET").otherwise("RESEARCH_HORIZON")).withColumn("holding", F.coalesce(h("offset"), F.lit(horizon)))
    last = F.element_at("walk", -1)
    price = F.when(F.col("reason") == "STOP", F.least(h("open"), h("level"))).when(F.col("reason") == "TARGET", F.greatest(h("open"), F.col("goal"))).otherwise(last["close"])
    rows = rows.withColumn("market_exit", price).withColumn("gap_through", F.col("stopped") & yes(h("stop_open")))
    realized = costs.exit(F.col("market_exit"), F.col("stopped")) / costs.entry(entry) - 1
    gross = F.col("market_exit") / entry - 1
    return rows.select(
        *EVENT_KEY, "policy_id", "family", "entry", F.col("stop").alias("initial_stop"), F.col("goal").alias("initial_target"), "reason", F.coalesce(h("bar_date"), last["bar_date"]).alias("exit_date"), "market_exit", "ambiguous",
        gross.alias("gross_return"), realized.alias("realized_return"), (gross - realized).alias("cost_drag"), (costs.exit(last["close"], F.lit(False)) / costs.entry(entry) - 1).alias("hold_return"), "gap_through",
        F.when(F.col("gap_through"), F.greatest(F.lit(0.0), (h("level") - h("open")) / entry)).otherwise(0.0).alias("gap_loss"), F.col("holding").alias("holding_sessions"),
        F.array_min(F.transform(F.slice("walk", F.lit(1), F.col("holding")), lambda x: x["low"] / entry - 1)).alias("mae_before_exit"), F.array_max(F.transform("walk", lambda x: x["high"] / entry - 1)).alias("mfe_full"),
    )


def exit_summary(results: DataFrame) -> DataFrame:
    """Per policy: rates, expectancy and its gap to holding, winners and losers, tail, holding, excursions, gaps, costs."""
    r = F.col("realized_return")
    win, loss, rate = F.when(r > 0, r), F.when(r < 0, r), lambda x: F.avg(x.cast("double"))
    return results.groupBy("policy_id", "family").agg(
        F.count("*").alias("n"), rate(F.col("reason") == "STOP").alias("stop_rate"), rate(F.col("reason") == "TARGET").alias("target_rate"), rate(F.col("ambiguous")).alias("ambiguous_rate"),
        F.avg(r).alias("expectancy"), (F.avg(r) - F.avg("hold_return")).alias("delta_vs_hold"), F.percentile(r, 0.5).alias("median_return"), rate(r > 0).alias("win_probability"), F.avg(win).alias("average_winner"), F.avg(loss).alias("average_loser"),
        F.try_divide(F.avg(win), -F.avg(loss)).alias("payoff"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"), F.percentile(r, 0.05).alias("tail_p05"), F.avg("holding_sessions").alias("holding_sessions"), F.percentile("holding_sessions", 0.5).alias("median_holding"),
        F.percentile("mae_before_exit", 0.5).alias("median_mae"), F.percentile("mfe_full", 0.5).alias("median_mfe"), rate(F.col("gap_through")).alias("gap_rate"), F.avg(F.when(F.col("gap_through"), F.col("gap_loss"))).alias("mean_gap_loss"), F.avg("cost_drag").alias("mean_cost_drag"),
    )
