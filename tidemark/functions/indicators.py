"""Indicators as window columns. A frame counts only when it is full: a short frame, or a null in it, gives null."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import by_date

YEAR = 252.0


def full(agg, x: Column, n: int, last: int = 0) -> Column:
    """``agg`` of ``x`` over the ``n`` rows that end ``-last`` rows before the current one."""
    frame = by_date().rowsBetween(last - n + 1, last)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def before(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by_date())


def sma(x: Column, n: int) -> Column:
    return full(F.avg, x, n)


def change(x: Column, n: int) -> Column:
    return x / before(x, n) - 1


def true_range() -> Column:
    last = before(F.col("close"), 1)
    return F.when(last.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))


def atr(n: int = 14) -> Column:
    """Simple mean of true ranges; each needs a prior close. Uses the ``tr`` column."""
    return full(F.avg, F.col("tr"), n)


def log_return(x: Column) -> Column:
    return F.ln(x / before(x, 1))


def rising_cross(fast: Column, slow: Column) -> Column:
    """1 when fast is above slow now and was not one row ago, else 0; null while any of the four is."""
    old_fast, old_slow = before(fast, 1), before(slow, 1)
    known = fast.isNotNull() & slow.isNotNull() & old_fast.isNotNull() & old_slow.isNotNull()
    return F.when(known, F.when((fast > slow) & (old_fast <= old_slow), 1.0).otherwise(0.0))


def falling_cross(fast: Column, slow: Column) -> Column:
    return rising_cross(slow, fast)


def with_initial(df):
    """The first feature set: sma_50, sma_200, atr_14, return_60, avg_dollar_volume_20, rolling_range_pct_30."""
    c = F.col("close")
    width = full(F.max, F.col("high"), 30) - full(F.min, F.col("low"), 30)
    return (
        df.withColumn("tr", true_range())
        .withColumn("sma_50", sma(c, 50))
        .withColumn("sma_200", sma(c, 200))
        .withColumn("atr_14", atr())
        .withColumn("return_60", change(c, 60))
        .withColumn("avg_dollar_volume_20", full(F.avg, c * F.col("volume"), 20))
        .withColumn("rolling_range_pct_30", width / c * 100)
    )


def with_market(df):
    """The market-analysis set that bounded frames can express."""
    c, v = F.col("close"), F.col("volume")
    df = df.withColumn("tr", true_range()).withColumn("lr", log_return(c))
    for n in (5, 20, 252):
        df = df.withColumn(f"return_{n}", change(c, n))
    df = df.withColumn("realized_volatility_20", full(F.stddev_samp, F.col("lr"), 20) * F.sqrt(F.lit(YEAR)))
    df = df.withColumn("relative_volume_20", v / full(F.avg, v, 20, -1))
    df = df.withColumn("average_dollar_volume_20", full(F.avg, c * v, 20, -1))
    df = df.withColumn("atr_pct_14", atr() / c * 100)
    for n in (20, 50, 200):
        df = df.withColumn(f"sma_{n}", sma(c, n)).withColumn(f"distance_sma_{n}_pct", (c / F.col(f"sma_{n}") - 1) * 100)
    for n in (50, 200):
        s = F.col(f"sma_{n}")
        df = df.withColumn(f"sma_{n}_slope_20_pct", (s / before(s, 20) - 1) * 100)
    fast, slow = F.col("sma_50"), F.col("sma_200")
    df = df.withColumn("sma_50_200_spread_pct", (fast / slow - 1) * 100).withColumn("sma_50_200_cross_up", rising_cross(fast, slow))
    for n in (20, 55):
        df = df.withColumn(f"distance_prior_high_{n}_pct", (c / full(F.max, F.col("high"), n, -1) - 1) * 100)
    high, low = full(F.max, F.col("high"), 20, -1), full(F.min, F.col("low"), 20, -1)
    return df.withColumn("range_position_prior_20", F.when(high - low > 0, (c - low) / (high - low)))


MARKET = (
    "return_5", "return_20", "return_252", "realized_volatility_20", "relative_volume_20", "average_dollar_volume_20", "atr_pct_14",
    "distance_sma_20_pct", "distance_sma_50_pct", "distance_sma_200_pct", "sma_50_slope_20_pct", "sma_200_slope_20_pct", "sma_50_200_spread_pct",
    "sma_50_200_cross_up", "distance_prior_high_20_pct", "distance_prior_high_55_pct", "range_position_prior_20",
)


def with_bollinger(df, n: int = 20, k: float = 2.0, source: str = "close"):
    """Bollinger columns (population deviation): bands, distances, reached, crosses, bandwidth, position."""
    x, c = F.col(source), F.col("close")
    df = df.withColumn("bb_middle", sma(x, n)).withColumn("bb_sd", full(F.stddev_pop, x, n))
    df = df.withColumn("bb_upper", F.col("bb_middle") + k * F.col("bb_sd")).withColumn("bb_lower", F.col("bb_middle") - k * F.col("bb_sd"))
    up, mid, low = F.col("bb_upper"), F.col("bb_middle"), F.col("bb_lower")
    wide = up - low
    for name, band in (("upper", up), ("middle", mid), ("lower", low)):
        df = df.withColumn(f"bb_{name}_distance_pct", F.try_divide(c, band) * 100 - 100)
    return (
        df.withColumn("bb_upper_reached", F.when(up.isNotNull(), (F.col("high") >= up).cast("double")))
        .withColumn("bb_lower_reached", F.when(low.isNotNull(), (F.col("low") <= low).cast("double")))
        .withColumn("bb_upper_cross_up", rising_cross(c, up))
        .withColumn("bb_lower_cross_down", falling_cross(c, low))
        .withColumn("bb_middle_cross_up", rising_cross(c, mid))
        .withColumn("bb_middle_cross_down", falling_cross(c, mid))
        .withColumn("bb_bandwidth_pct", F.try_divide(wide, mid) * 100)
        .withColumn("bb_position", F.when(wide > 0, (c - low) / wide))
    )


BOLLINGER = (
    "bb_upper_distance_pct", "bb_middle_distance_pct", "bb_lower_distance_pct", "bb_upper_reached", "bb_lower_reached", "bb_upper_cross_up",
    "bb_lower_cross_down", "bb_middle_cross_up", "bb_middle_cross_down", "bb_bandwidth_pct", "bb_position",
)


def roc_pct(x: Column, n: int) -> Column:
    return change(x, n) * 100


def historical_volatility_pct(n: int) -> Column:
    """Needs the ``lr`` column."""
    return full(F.stddev_samp, F.col("lr"), n) * F.sqrt(F.lit(YEAR)) * 100


def prior_high_breakout(n: int) -> Column:
    high = full(F.max, F.col("high"), n, -1)
    return F.when(high.isNotNull(), (F.col("close") > high).cast("double"))


def narrow_range(n: int) -> Column:
    """1 when today's range is strictly below each of the n - 1 ranges before."""
    width = F.col("high") - F.col("low")
    least = full(F.min, width, n - 1, -1)
    return F.when(least.isNotNull(), (width < least).cast("double"))


def share_at_most(x: Column, n: int) -> Column:
    """100 * share of the last n values that are at most the current one."""
    frame = by_date().rowsBetween(1 - n, 0)
    values = F.collect_list(x).over(frame)
    return F.when(F.count(x).over(frame) == n, 100.0 * F.size(F.filter(values, lambda v: v <= x)) / n)


def availability(name: str, least_rows: int) -> Column:
    """AVAILABLE, WARMUP (too few rows so far) or INPUT_UNAVAILABLE."""
    return F.when(F.col(name).isNotNull(), "AVAILABLE").when(F.col("signal_index") + 1 < least_rows, "WARMUP").otherwise("INPUT_UNAVAILABLE")


def to_long(df, names, versions: str = "v1"):
    """Wide features as rows (instrument_id, trade_date, feature_name, value): the form of the feature store."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.selectExpr("instrument_id", "trade_date", f"stack({len(names)}, {pairs}) as (feature_name, value)").withColumn("feature_version", F.lit(versions))


def unbounded():
    return by_date().rowsBetween(Window.unboundedPreceding, 0)
