"""Initial stops of events: static levels of six families, the first bar that touches one, and what came of it.

The bars behind an event are one array of bounded length, so all policies are evaluated on it row by row:
after the one grouping that makes the arrays, nothing is shuffled whatever the number of policies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.outcomes import EVENT_KEY, walked

# Fixed values: (policy_id, family, size) of the grid. Sizes are a share of the entry or a multiple of the ATR.
POLICIES = (
    ("no-stop-horizon", "NO_STOP", 0.0),
    *((f"fixed-{p}pct", "FIXED_PERCENT", p / 100) for p in (2, 3, 4, 5, 7, 10)),
    *((f"atr-{m:g}x", "ATR", m) for m in (1.0, 1.5, 2.0, 2.5, 3.0)),
    ("structural-base-low", "STRUCTURAL_BASE_LOW", 0.0),
    ("structural-boundary", "STRUCTURAL_BOUNDARY", 0.0),
    ("structural-boundary-0.5atr-buffer", "STRUCTURAL_BOUNDARY", 0.5),
    ("hybrid-base-low-or-2atr-wider", "HYBRID_STRUCTURAL_ATR", 2.0),
)


@dataclass(frozen=True)
class Costs:
    """Basis points of one side; a stop's exit pays ``stop_slippage`` besides."""

    entry_slippage: float = 0.0
    exit_slippage: float = 0.0
    stop_slippage: float = 0.0
    commission: float = 0.0

    def entry(self, price: Column) -> Column:
        return price * (1 + (self.entry_slippage + self.commission) / 1e4)

    def exit(self, price: Column, stopped: Column) -> Column:
        bps = F.when(stopped, self.exit_slippage + self.commission + self.stop_slippage).otherwise(self.exit_slippage + self.commission)
        return price * (1 - bps / 1e4)


def event_paths(events: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Events whose whole path of ``horizon`` bars is there and usable: key, context columns, ``path`` in order."""
    bar = F.struct("offset", "open", "high", "low", "close", "bar_date")
    found = walked(events, bars, horizon).groupBy(*EVENT_KEY).agg(F.sort_array(F.collect_list(bar)).alias("path"), F.min(F.col("ok").cast("int")).alias("ok"))
    return events.join(found.where((F.size("path") == horizon) & (F.col("ok") == 1)).drop("ok"), list(EVENT_KEY))


def stop_level(entry: Column) -> Column:
    """Of the row's family and size; null where there is no stop, or no ATR or structure to build it from."""
    size, atr = F.col("size"), F.col("atr")
    return (
        F.when(F.col("family") == "FIXED_PERCENT", entry * (1 - size))
        .when(F.col("family") == "ATR", entry - size * atr)
        .when(F.col("family") == "STRUCTURAL_BASE_LOW", F.col("support"))
        .when((F.col("family") == "STRUCTURAL_BOUNDARY") & (size == 0), F.col("resistance"))
        .when(F.col("family") == "STRUCTURAL_BOUNDARY", F.col("resistance") - size * atr)
        .when((F.col("family") == "HYBRID_STRUCTURAL_ATR") & atr.isNotNull(), F.least(F.col("support"), entry - size * atr))
    )


def stop_results(events: DataFrame, bars: DataFrame, horizon: int, policies: Sequence[tuple] = POLICIES, costs: Costs = Costs(), reach: float = 0.05) -> DataFrame:
    """One row per event and policy, over the events that have a whole path and all levels: the same events for every policy.

    ``events`` has support, resistance and atr, all known before the entry. A stop at or above the entry is left at
    once; else the first bar that opens at or below it fills at its open, the first that trades there at the level.
    ``premature`` says whether holding on would have ended above zero after costs; ``reached`` whether the price later rose
    by ``reach`` above the entry (in the stop's own bar the order is unknown).
    """
    table = F.array(*[F.struct(F.lit(i).alias("policy_id"), F.lit(f).alias("family"), F.lit(float(z)).alias("size")) for i, f, z in policies])
    rows = event_paths(events, bars, horizon).select("*", F.explode(table).alias("p")).select("*", "p.*").drop("p")
    entry, last = F.col("path")[0]["open"], F.element_at("path", -1)["close"]
    rows = rows.withColumn("entry", entry).withColumn("stop", stop_level(F.col("entry")))
    known = F.col("stop").isNotNull() | (F.col("family") == "NO_STOP")
    lacking = rows.where(~known).select(*EVENT_KEY).distinct()
    rows = rows.join(lacking, list(EVENT_KEY), "left_anti")
    hit = F.get(F.filter("path", lambda x: (x["open"] <= F.col("stop")) | (x["low"] <= F.col("stop"))), F.lit(0))
    at_once = F.coalesce(F.col("stop") >= F.col("entry"), F.lit(False))
    rows = rows.withColumn("at_once", at_once).withColumn("hit", F.when(~F.col("at_once"), hit))
    rows = rows.withColumn("stopped", F.col("at_once") | F.col("hit").isNotNull()).withColumn("gapped", F.coalesce(F.col("hit.open") <= F.col("stop"), F.lit(False)))
    rows = rows.withColumn("holding", F.when(F.col("at_once"), 1).otherwise(F.coalesce("hit.offset", F.lit(horizon))))
    market = F.when(F.col("at_once"), F.col("entry")).when(F.col("gapped"), F.col("hit.open")).when(F.col("stopped"), F.col("stop")).otherwise(last)
    rows = rows.withColumn("market_exit", market).withColumn("paid", costs.entry(F.col("entry")))
    highs = F.transform("path", lambda x: x["high"] / F.col("entry") - 1)
    behind = F.slice("path", F.col("holding") + 1, F.lit(horizon))
    goal = F.col("entry") * (1 + reach)
    rows = rows.withColumn("realized", costs.exit(F.col("market_exit"), F.col("stopped")) / F.col("paid") - 1).withColumn("held", costs.exit(last, F.lit(False)) / F.col("paid") - 1)
    gross = F.col("market_exit") / F.col("entry") - 1
    risk = F.when(F.col("stop") < F.col("entry"), (F.col("entry") - F.col("stop")) / F.col("entry"))
    premature = F.when(~F.col("stopped"), "NOT_APPLICABLE").when(F.col("held") > 0, "YES").otherwise("NO")
    own = F.element_at("path", F.col("holding"))
    reached = F.when(~F.col("stopped"), "NOT_APPLICABLE").when(own["high"] >= goal, "SAME_BAR_AMBIGUOUS").when(F.exists(behind, lambda x: x["high"] >= goal), "YES").otherwise("NO")
    return rows.select(
        *EVENT_KEY, "policy_id", "family", "entry", F.col("stop").alias("initial_stop"),
        F.when(F.col("at_once"), "ENTRY_AT_OR_BELOW_STOP").when(F.col("stopped"), "STOP").otherwise("RESEARCH_HORIZON").alias("reason"),
        own["bar_date"].alias("exit_date"), "market_exit", gross.alias("gross_return"), F.col("realized").alias("realized_return"), (gross - F.col("realized")).alias("cost_drag"),
        risk.alias("initial_risk"), F.try_divide(F.col("realized"), risk).alias("realized_r"), "stopped", premature.alias("premature"), reached.alias("reached"),
        F.col("gapped").alias("gap_through"), F.when(F.col("gapped"), (F.col("stop") - F.col("hit.open")) / F.col("entry")).otherwise(0.0).alias("gap_loss"), F.col("holding").alias("holding_sessions"),
        F.array_min(F.transform(F.slice("path", F.lit(1), F.col("holding")), lambda x: x["low"] / F.col("entry") - 1)).alias("mae_before_exit"),
        F.array_max(highs).alias("mfe_full"), F.when(F.col("stopped"), F.array_max(F.slice(highs, F.col("holding"), F.lit(horizon)))).alias("post_stop_mfe"), F.col("held").alias("no_stop_return"),
    )


def stop_summary(results: DataFrame, premature: str = "reached") -> DataFrame:
    """Per policy: rates, expectancy and its gap to no stop, winners and losers, R, bounds of the premature rate, tails, costs."""
    r, out = F.col("realized_return"), F.col("stopped")
    share = lambda x: F.avg(F.when(out, x.cast("double")))  # noqa: E731  of the stopped ones; null without any
    win, loss, early = F.when(r > 0, r), F.when(r < 0, r), F.col(premature)
    return results.groupBy("policy_id", "family").agg(
        F.count("*").alias("n"), F.count_if(out).alias("stop_outs"), F.avg(out.cast("double")).alias("stop_out_rate"),
        F.avg(r).alias("expectancy"), (F.avg(r) - F.avg("no_stop_return")).alias("delta_vs_no_stop"), F.percentile(r, 0.5).alias("median_return"), F.avg((r > 0).cast("double")).alias("win_probability"),
        F.avg(win).alias("average_winner"), F.percentile(win, 0.5).alias("median_winner"), F.avg(loss).alias("average_loser"), F.percentile(loss, 0.5).alias("median_loser"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.avg("realized_r").alias("average_r"), F.percentile("realized_r", 0.5).alias("median_r"),
        share(early == "YES").alias("premature_lower"), share(early.isin("YES", "SAME_BAR_AMBIGUOUS")).alias("premature_upper"), share(early == "SAME_BAR_AMBIGUOUS").alias("premature_ambiguous"),
        share(F.col("gap_through")).alias("gap_through_rate"), F.avg(F.when(F.col("gap_through"), F.col("gap_loss"))).alias("mean_gap_loss"), F.percentile(r, 0.05).alias("tail_p05"), F.avg("holding_sessions").alias("holding_sessions"),
        F.percentile("mae_before_exit", 0.5).alias("median_mae"), F.percentile("mfe_full", 0.5).alias("median_mfe"), F.avg("initial_risk").alias("mean_initial_risk"), F.avg("cost_drag").alias("mean_cost_drag"),
    )


def comparison_population(events: DataFrame, results: DataFrame) -> DataFrame:
    """Every requested event and whether the comparison holds it."""
    kept = results.select(*EVENT_KEY).distinct().withColumn("evaluated", F.lit(True))
    return events.select(*EVENT_KEY).join(kept, list(EVENT_KEY), "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))
