"""Recursive indicators: smoothing whose state runs through a whole series.

A window cannot express them, so each series goes once through a grouped kernel that returns all asked
columns. ``gap`` says what a missing input does: "reset" starts anew behind it, "stop" ends the series.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Kernel = Callable[[pd.DataFrame], np.ndarray]


class Smoothing(NamedTuple):
    """Where a smoothing stands: values of the seed so far, the last result, and whether a gap has ended it."""

    seed: tuple[float, ...] = ()
    value: float | None = None
    ended: bool = False


def smoothed(x: np.ndarray, n: int, weight: float, gap: str, state: Smoothing = Smoothing()) -> tuple[np.ndarray, Smoothing]:
    """Seed with the mean of ``n`` values in a row, then weight * x + (1 - weight) * last; goes on from ``state``."""
    out = np.full(len(x), np.nan)
    seed, value, ended = list(state.seed), state.value, state.ended
    for i, v in enumerate(x.tolist()):
        if ended:
            break
        if not np.isfinite(v):
            ended = gap == "stop" and (value is not None or bool(seed))
            seed, value = [], None
            continue
        if value is None:
            seed.append(v)
            if len(seed) == n:
                value, seed = float(np.mean(seed)), []
                out[i] = value
        else:
            value = weight * v + (1 - weight) * value
            out[i] = value
    return out, Smoothing(tuple(seed), value, ended)


def _smoothed(x: np.ndarray, n: int, weight: float, gap: str) -> np.ndarray:
    return smoothed(x, n, weight, gap)[0]


def ema(x: np.ndarray, n: int, gap: str = "reset") -> np.ndarray:
    return _smoothed(x, n, 2 / (n + 1), gap)


def wilder(x: np.ndarray, n: int, gap: str = "reset") -> np.ndarray:
    return _smoothed(x, n, 1 / n, gap)


def rsi(x: np.ndarray, n: int, gap: str = "reset") -> np.ndarray:
    move = np.diff(x, prepend=np.nan)
    return rsi_from(wilder(np.maximum(move, 0), n, gap), wilder(np.maximum(-move, 0), n, gap))


def rsi_from(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The index from smoothed rises and falls."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    out = np.where((up == 0) & (down == 0), 50.0, np.where(down == 0, 100.0, np.where(up == 0, 0.0, out)))
    return np.where(np.isnan(up), np.nan, out)


def true_ranges(p: pd.DataFrame) -> np.ndarray:
    high, low, last = p["high"].to_numpy(), p["low"].to_numpy(), p["close"].shift(1).to_numpy()
    return np.where(np.isnan(last), np.nan, np.maximum(high - low, np.maximum(np.abs(high - last), np.abs(low - last))))


def crossed(fast: np.ndarray, slow: np.ndarray) -> np.ndarray:
    f1, s1 = np.concatenate(([np.nan], fast[:-1])), np.concatenate(([np.nan], slow[:-1]))
    known = ~(np.isnan(fast) | np.isnan(slow) | np.isnan(f1) | np.isnan(s1))
    return np.where(known, ((fast > slow) & (f1 <= s1)).astype(float), np.nan)


def ema_of(source: str, n: int, gap: str = "reset") -> Kernel:
    return lambda p: ema(p[source].to_numpy(), n, gap)


def rsi_of(source: str, n: int, gap: str = "reset") -> Kernel:
    return lambda p: rsi(p[source].to_numpy(), n, gap)


def atr_pct_of(n: int) -> Kernel:
    return lambda p: wilder(true_ranges(p), n) / p["close"].to_numpy() * 100


def macd_set(fast: int, slow: int, signal: int, gap: str = "reset") -> dict[str, Kernel]:
    def parts(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = p["close"].to_numpy()
        line = ema(c, fast, gap) - ema(c, slow, gap)
        return line, ema(line, signal, "reset"), c

    def line(p):
        x, _, c = parts(p)
        return x / c * 100

    def smooth(p):
        _, s, c = parts(p)
        return s / c * 100

    def histogram(p):
        x, s, c = parts(p)
        return (x - s) / c * 100

    def cross(p):
        x, s, _ = parts(p)
        return crossed(x, s)

    return {"macd_line_pct": line, "macd_signal_pct": smooth, "macd_histogram_pct": histogram, "macd_bullish_cross": cross}


def keltner_set(n: int, atr: int, width: float) -> dict[str, Kernel]:
    def parts(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        c = p["close"].to_numpy()
        middle, spread = ema(c, n, "stop"), width * wilder(true_ranges(p), atr, "reset")
        return c, middle + spread, middle, middle - spread

    def upper(p):
        c, u, _, _ = parts(p)
        return (c / u - 1) * 100

    def lower(p):
        c, _, _, d = parts(p)
        return (c / d - 1) * 100

    def band(p):
        _, u, m, d = parts(p)
        return (u - d) / m * 100

    def position(p):
        c, u, _, d = parts(p)
        return np.where(u - d > 0, (c - d) / (u - d), np.nan)

    def cross_up(p):
        c, u, _, _ = parts(p)
        return crossed(c, u)

    def cross_down(p):
        c, _, _, d = parts(p)
        return crossed(d, c)

    return {"kc_upper_distance_pct": upper, "kc_lower_distance_pct": lower, "kc_bandwidth_pct": band, "kc_position": position, "kc_upper_cross_up": cross_up, "kc_lower_cross_down": cross_down}


def apply(bars: DataFrame, kernels: dict[str, Kernel]) -> DataFrame:
    """``bars`` with a column per kernel; a group is one instrument's series of daily bars."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("trade_date", ignore_index=True)
        out = p[["instrument_id", "trade_date"]].copy()
        for name, kernel in kernels.items():
            out[name] = pd.Series(kernel(p)).where(lambda s: s.notna(), None)
        return out

    schema = "instrument_id string, trade_date date, " + ", ".join(f"`{k}` double" for k in kernels)
    return bars.select("instrument_id", "trade_date", "open", "high", "low", "close", "volume").groupBy("instrument_id").applyInPandas(run, schema)
