"""Indicators by name: ``pi__family__metric__source__p20__suffix`` says all there is to compute.

The names in a strategy's expression decide what a frame computes. Indicators over bounded windows become window
columns of one sort; those whose state runs through a series go once, all together, through a kernel behind the same
sort. A series that several indicators need, say the bands of Bollinger or the lines of MACD, is computed once.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import recursive as rec
from tidemark.functions.expressions import ExpressionError, compile_expression, decode_number, encode_number
from tidemark.functions.indicators import YEAR, before, full

PREFIX = "pi__"
# Families with their metrics, and what the last part of their names says.
METRICS = {
    "moving_average": ("ma_distance_pct", "ma_cross_up", "ma_cross_down"),
    "bollinger_bands": (
        "bb_upper_distance_pct", "bb_middle_distance_pct", "bb_lower_distance_pct", "bb_upper_reached", "bb_lower_reached", "bb_upper_cross_up",
        "bb_lower_cross_down", "bb_middle_cross_up", "bb_middle_cross_down", "bb_bandwidth_pct", "bb_position",
    ),
    "price_roc": ("roc_pct",),
    "rsi": ("rsi_value",),
    "macd": ("macd_line_pct", "macd_signal_pct", "macd_histogram_pct", "macd_cross_up", "macd_cross_down"),
    "atr": ("atr_pct",),
    "relative_volume": ("rvol",),
    "average_dollar_volume": ("average_dollar_volume",),
    "historical_volatility": ("historical_volatility_pct",),
    "prior_high": ("prior_high_distance_pct", "prior_high_breakout"),
}
SUFFIXES = {"price_roc": "standard", "rsi": "wilder", "atr": "wilder", "relative_volume": "prior", "average_dollar_volume": "prior", "historical_volatility": "annual252", "prior_high": "prior"}
SOURCES = ("open", "high", "low", "close")
_MACD = re.compile(r"f(\d+)s(\d+)g(\d+)")


class Spec(NamedTuple):
    """One indicator: ``average`` is sma or ema, ``width`` the deviations of Bollinger bands, ``macd`` the fast, slow and signal lengths."""

    family: str
    metric: str
    period: int
    source: str = "close"
    average: str = "sma"
    width: float = 2.0
    macd: tuple[int, int, int] = (12, 26, 9)

    @property
    def name(self) -> str:
        suffix = {"moving_average": self.average, "bollinger_bands": f"k{encode_number(self.width)}", "macd": "f{}s{}g{}".format(*self.macd)}.get(self.family) or SUFFIXES[self.family]
        return "__".join(("pi", self.family, self.metric, self.source, f"p{self.period}", suffix))

    def checked(self) -> Spec:
        fast, slow, signal = self.macd
        if self.metric not in METRICS.get(self.family, ()) or self.source not in SOURCES or self.average not in ("sma", "ema"):
            raise ExpressionError(f"no such indicator: {tuple(self)}")
        if not 2 <= self.period <= 1000 or not (math.isfinite(self.width) and 0.01 <= self.width <= 20) or not 2 <= fast < slow <= 1000 or not 2 <= signal <= 1000:
            raise ExpressionError(f"parameters out of range: {tuple(self)}")
        return self

    @property
    def recursive(self) -> bool:
        return self.family in ("rsi", "macd", "atr") or (self.family == "moving_average" and self.average == "ema")

    @property
    def least_rows(self) -> int:
        """Bars up to the first value."""
        binary = "_cross_" in self.metric
        if self.family == "macd":
            return self.macd[1] + self.macd[2] - 1 + binary
        if self.family in ("moving_average", "bollinger_bands"):
            return self.period + binary
        return self.period + 1


def parse_name(name: str) -> Spec:
    """The indicator of a name; the name must be the one that the indicator has."""
    parts = name.split("__")
    if len(parts) != 6 or parts[0] != "pi" or not re.fullmatch(r"p\d+", parts[4]):
        raise ExpressionError(f"not a name of an indicator: {name}")
    _, family, metric, source, period, suffix = parts
    more: dict = {}
    try:
        if family == "moving_average":
            more = {"average": suffix}
        elif family == "bollinger_bands":
            more = {"width": decode_number(suffix.removeprefix("k"))}
        elif family == "macd":
            more = {"macd": tuple(map(int, _MACD.fullmatch(suffix).groups()))}
    except (ValueError, AttributeError) as error:
        raise ExpressionError(f"not a name of an indicator: {name}") from error
    spec = Spec(family, metric, int(period[1:]), source, **more).checked()
    if spec.name != name:
        raise ExpressionError(f"not a name of an indicator: {name}")
    return spec


def specs_of(expression: str) -> list[Spec]:
    """The indicators that an expression names, each once, by name."""
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except SyntaxError as error:
        raise ExpressionError(str(error)) from error
    return [parse_name(n) for n in sorted({x.id for x in ast.walk(tree) if isinstance(x, ast.Name) and x.id.startswith(PREFIX)})]


def _price(name: str) -> Column:
    x = F.col(name)
    return F.when((x > 0) & (x < F.lit(math.inf)), x)


def _crosses(up: bool, fast: Column, slow: Column) -> Column:
    """1 or 0 where both series are known now and one row ago."""
    a, b = (fast, slow) if up else (slow, fast)
    old_a, old_b = before(a, 1), before(b, 1)
    return F.when(a.isNotNull() & b.isNotNull() & old_a.isNotNull() & old_b.isNotNull(), ((a > b) & (old_a <= old_b)).cast("double"))


def _windows(spec: Spec) -> dict[str, Column]:
    """The windowed series that a metric needs, by column name."""
    n, x = spec.period, F.col(f"_{spec.source}")
    match spec.family:
        case "moving_average":
            return {f"_sma_{spec.source}_{n}": full(F.avg, x, n)}
        case "bollinger_bands":
            return {f"_sma_{spec.source}_{n}": full(F.avg, x, n), f"_sd_{spec.source}_{n}": full(F.stddev_pop, x, n)}
        case "price_roc":
            return {f"_back_{spec.source}_{n}": before(x, n)}
        case "relative_volume":
            return {f"_volume_{n}": full(F.avg, F.col("volume"), n, -1)}
        case "average_dollar_volume":
            return {f"_dollars_{n}": full(F.avg, F.col("close") * F.col("volume"), n, -1)}
        case "historical_volatility":
            return {f"_spread_{spec.source}_{n}": full(F.stddev_samp, F.col(f"_log_{spec.source}"), n)}
        case _:
            return {f"_top_{n}": full(F.max, F.col("_high"), n, -1)}


def _metric(spec: Spec) -> Column:
    """The value of a metric over the columns of :func:`_windows`."""
    n, x, m = spec.period, F.col(f"_{spec.source}"), spec.metric
    mean = F.col(f"_sma_{spec.source}_{n}")
    if spec.family == "moving_average":
        return (x / mean - 1) * 100 if m == "ma_distance_pct" else _crosses(m.endswith("up"), x, mean)
    if spec.family == "bollinger_bands":
        spread = F.lit(float(spec.width)) * F.col(f"_sd_{spec.source}_{n}")
        bands = {"upper": mean + spread, "middle": mean, "lower": mean - spread}
        wide = bands["upper"] - bands["lower"]
        if m == "bb_bandwidth_pct":
            return wide / mean * 100
        if m == "bb_position":
            return F.when(wide > 0, (x - bands["lower"]) / wide)
        band = bands[m.split("_")[1]]
        if m.endswith("distance_pct"):
            return (F.try_divide(x, band) - 1) * 100
        if m.endswith("reached"):
            return F.when(mean.isNotNull() & x.isNotNull(), ((F.col("_high") >= band) if "upper" in m else (F.col("_low") <= band)).cast("double"))
        return _crosses(m.endswith("up"), x, band)
    if spec.family == "price_roc":
        return (x / F.col(f"_back_{spec.source}_{n}") - 1) * 100
    if spec.family == "relative_volume":
        return F.when(F.col(f"_volume_{n}") > 0, F.col("volume") / F.col(f"_volume_{n}"))
    if spec.family == "average_dollar_volume":
        return F.col(f"_dollars_{n}")
    if spec.family == "historical_volatility":
        return F.col(f"_spread_{spec.source}_{n}") * math.sqrt(YEAR) * 100
    top = F.col(f"_top_{n}")
    return (x / top - 1) * 100 if m == "prior_high_distance_pct" else F.when(x.isNotNull() & top.isNotNull(), (x > top).cast("double"))


class _Series:
    """Series of one instrument, each computed when it is first asked for."""

    def __init__(self, p: pd.DataFrame):
        self.p, self.known = p, {}

    def price(self, name: str) -> np.ndarray:
        x = self.p[name].to_numpy(dtype=float, na_value=np.nan)
        return np.where(np.isfinite(x) & (x > 0), x, np.nan)

    def get(self, kind: str, source: str, n: int) -> np.ndarray:
        key = (kind, source, n)
        if key not in self.known:
            self.known[key] = getattr(self, f"_{kind}")(source, n)
        return self.known[key]

    def _ema(self, source: str, n: int) -> np.ndarray:
        x = self.price(source)
        whole = len(x) >= n and np.isfinite(x[:n]).all()
        return rec.ema(x, n, "stop") if whole else np.full(len(x), np.nan)

    def _rsi(self, source: str, n: int) -> np.ndarray:
        x = self.price(source)
        whole = len(x) > n and np.isfinite(x[: n + 1]).all()
        return rec.rsi(x, n, "stop") if whole else np.full(len(x), np.nan)

    def _atr(self, source: str, n: int) -> np.ndarray:
        high, low, last = self.price("high"), self.price("low"), np.concatenate(([np.nan], self.price("close")[:-1]))
        return rec.wilder(np.where(np.isnan(high + low + last), np.nan, np.maximum(high - low, np.maximum(np.abs(high - last), np.abs(low - last)))), n, "stop")

    def value(self, s: Spec) -> np.ndarray:
        x = self.price(s.source)
        if s.family == "rsi":
            return self.get("rsi", s.source, s.period)
        if s.family == "atr":
            return self.get("atr", "close", s.period) / self.price("close") * 100
        if s.family == "moving_average":
            mean = self.get("ema", s.source, s.period)
            return (x / mean - 1) * 100 if s.metric == "ma_distance_pct" else rec.crossed(x, mean) if s.metric.endswith("up") else rec.crossed(mean, x)
        fast, slow, n = s.macd
        line = self.get("ema", s.source, fast) - self.get("ema", s.source, slow)
        signal = self.known.setdefault(("signal", s.source, s.macd), None)
        if signal is None:
            signal = self.known[("signal", s.source, s.macd)] = rec.ema(line, n, "stop")
        plain = {"macd_line_pct": line, "macd_signal_pct": signal, "macd_histogram_pct": line - signal}
        if s.metric in plain:
            return plain[s.metric] / x * 100
        out = rec.crossed(line, signal) if s.metric.endswith("up") else rec.crossed(signal, line)
        return np.where(np.isnan(x), np.nan, out)


def with_indicators(bars: DataFrame, specs: Iterable[Spec]) -> DataFrame:
    """``bars`` with a column for each of ``specs``, under its name; null while there is no value.

    A spec that comes twice is one column. A name that ``bars`` has already raises. A bar that is not PASS fails the job.
    """
    specs = list(dict.fromkeys(s.checked() for s in specs))
    if taken := sorted({s.name for s in specs} & set(bars.columns)):
        raise ExpressionError(f"columns that would be shadowed: {taken}")
    if not specs:
        return bars
    columns = bars.columns
    plain, deep = [s for s in specs if not s.recursive], [s for s in specs if s.recursive]
    passed = F.when(F.col("quality_status") == "PASS", F.col("close")).otherwise(F.raise_error(F.concat(F.lit("a bar is not PASS: "), F.col("instrument_id"))).cast("double"))
    rows = bars.select(*[c for c in columns if c != "close"], passed.alias("close"))
    rows = rows.select("*", *[_price(c).alias(f"_{c}") for c in SOURCES])
    logs = sorted({s.source for s in plain if s.family == "historical_volatility"})
    if logs:
        rows = rows.select("*", *[F.ln(F.col(f"_{c}") / before(F.col(f"_{c}"), 1)).alias(f"_log_{c}") for c in logs])
    windows = {k: v for s in plain for k, v in _windows(s).items()}
    rows = rows.select("*", *[v.alias(k) for k, v in windows.items()]) if windows else rows
    rows = rows.select(*columns, *[_metric(s).alias(s.name) for s in plain])
    if not deep:
        return rows

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("trade_date", ignore_index=True)
        series = _Series(p)
        found = pd.DataFrame({s.name: series.value(s) for s in deep})
        return pd.concat([p, found.astype(object).where(found.notna(), None)], axis=1)

    schema = StructType([*rows.schema.fields, *[StructField(s.name, DoubleType()) for s in deep]])
    return rows.groupBy("instrument_id").applyInPandas(run, schema)


def strategy_frame(bars: DataFrame, expression: str, fixed: Iterable[str] = (), extra: DataFrame | None = None) -> DataFrame:
    """``bars`` with the indicators that ``expression`` names and whether it selects each bar, as ``selected``.

    ``fixed`` are columns of ``bars`` that it may name too, and ``extra`` features in long form
    (instrument_id, trade_date, feature_name, value). An extra feature that would shadow another column raises; one that comes twice
    for a bar, or for an instrument that has no bars, fails the job.
    """
    specs, fixed = specs_of(expression), set(fixed)
    rows, names = with_indicators(bars, specs), {s.name for s in specs} | fixed
    if extra is not None:
        own = sorted(r.feature_name for r in extra.select("feature_name").distinct().collect())  # one row a feature
        if clash := set(own) & (set(rows.columns) | names):
            raise ExpressionError(f"extra features would shadow {sorted(clash)}")
        one = F.when(F.count("*") > 1, F.raise_error(F.lit("an extra feature comes twice for a bar")).cast("double")).otherwise(F.min("value"))
        values = extra.groupBy("instrument_id", "trade_date", "feature_name").agg(one.alias("value"))
        wide = values.groupBy("instrument_id", "trade_date").pivot("feature_name", own).agg(F.first("value"))
        known = bars.select("instrument_id").distinct().withColumn("_known", F.lit(True))
        sure = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("an extra feature of an unknown instrument: "), F.col("instrument_id")))).otherwise(F.col("trade_date"))
        wide = wide.join(known, "instrument_id", "left").withColumn("trade_date", sure).drop("_known")
        rows, names = rows.join(wide, ["instrument_id", "trade_date"], "left"), names | set(own)
    return rows.withColumn("selected", compile_expression(expression, names).selected())
