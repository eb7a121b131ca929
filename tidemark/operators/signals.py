"""Entry selection: an expression picks rows, a rank feature keeps the best of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import compile_expression
from tidemark.functions.indicators import MARKET


def strategy_signals(featured: DataFrame, expression: str, rank: str, descending: bool = True, limit: int = 25, names=MARKET) -> DataFrame:
    """Rows that ``expression`` selects, at most ``limit`` a session by ``rank`` (ties by instrument), with their place.

    Rows whose rank is null do not count. Only the features that are named are computed: the others are
    lazy columns that the optimizer prunes.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie in 1..500")
    rule = compile_expression(expression, names)
    rows = featured.where(rule.selected() & F.col(rank).isNotNull())
    order = F.desc(rank) if descending else F.asc(rank)
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(order, "instrument_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def strategy_family(featured: DataFrame, strategies: dict[str, tuple[str, str, bool, int]], names=MARKET) -> DataFrame:
    """Signals of many strategies from one pass over the features: strategy, instrument_id, trade_date, signal_index, rank_value, place.

    Each row is kept once for each strategy that selects it, so the features are computed and read once; the
    ranking then goes by (strategy, session). The rules are those of :func:`strategy_signals`.
    """
    marks = []
    for name, (expression, rank, descending, limit) in strategies.items():
        if not 1 <= limit <= 500:
            raise ValueError("limit must lie in 1..500")
        chosen = compile_expression(expression, names).selected() & F.col(rank).isNotNull()
        order = -F.col(rank) if descending else F.col(rank)
        marks.append(F.when(chosen, F.struct(F.lit(name).alias("strategy"), F.col(rank).alias("rank_value"), order.alias("order"), F.lit(limit).alias("limit"))))
    rows = featured.select("instrument_id", "trade_date", "signal_index", F.explode(F.array_compact(F.array(*marks))).alias("x")).select("instrument_id", "trade_date", "signal_index", "x.*")
    place = F.row_number().over(Window.partitionBy("strategy", "trade_date").orderBy("order", "instrument_id"))
    return rows.withColumn("place", place).where(F.col("place") <= F.col("limit")).drop("order", "limit")


def entry_sweep(featured: DataFrame, feature: str, values: list[float], outcome: str) -> DataFrame:
    """Per value v: rows with ``feature`` >= v, those with an outcome, and their mean and positive share. At most 30 values, one pass."""
    if not 1 <= len(values) <= 30 or len(set(values)) != len(values):
        raise ValueError("between 1 and 30 different values")
    rows = featured.where(F.col(feature).isNotNull()).select(feature, outcome, F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("value"))
    hit = rows.where(F.col(feature) >= F.col("value")).groupBy("value").agg(F.count("*").alias("signals"), F.count(outcome).alias("complete"), F.avg(outcome).alias("mean_return"), F.avg((F.col(outcome) > 0).cast("double")).alias("positive_fraction"))
    every = featured.sparkSession.createDataFrame([(float(v),) for v in values], "value double")
    return every.join(hit, "value", "left").withColumn("signals", F.coalesce("signals", F.lit(0))).withColumn("complete", F.coalesce("complete", F.lit(0)))


#: Named entry rules: expression, rank feature, descending, limit.
PRESETS = {
    "prior_high_20": ("distance_prior_high_20_pct > 0", "distance_prior_high_20_pct", True, 25),
    "momentum_volume": ("return_20 >= 0.05 and relative_volume_20 >= 1.5 and distance_sma_200_pct > 0", "return_20", True, 25),
    "pullback": ("distance_sma_200_pct > 0 and -5 <= distance_sma_20_pct < 0", "distance_sma_20_pct", False, 2),
    "trend_cross": ("sma_50_200_cross_up == 1", "sma_50_200_spread_pct", True, 25),
    "range_low": ("range_position_prior_20 < 0.2 and not (return_5 > 0)", "range_position_prior_20", False, 3),
    "year_momentum": ("return_252 > 0", "return_252", True, 3),
}
