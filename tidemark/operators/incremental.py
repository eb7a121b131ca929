"""Features of new bars from stored state: what a batch over the whole history gives, from a bounded tail.

The state of an instrument is its last bars, as many as the longest window reaches back, and where each recursive
smoothing stands. A step takes the state and new bars, gives the features of the new bars and the next state, and
never reads the history again. Steps run over tables (:func:`advance`, :class:`FeatureLog`) or over a stream
(:mod:`tidemark.streaming.features`); both take the series of an instrument through :func:`stepped`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import recursive as rec
from tidemark.sources.files import Folder

#: Bars that the longest window needs before a new one.
TAIL = 199
BAR = ["trade_date", "open", "high", "low", "close", "volume"]
FEATURES = (
    "sma_50", "sma_200", "atr_14", "return_60", "avg_dollar_volume_20", "rolling_range_pct_30",
    "rsi_14", "macd_line_pct", "macd_signal_pct", "macd_histogram_pct", "macd_bullish_cross", "atr_wilder_pct_14",
)
#: Smoothings by name: length, weight of a new value.
SMOOTHINGS = {"up": (14, 1 / 14), "down": (14, 1 / 14), "fast": (12, 2 / 13), "slow": (26, 2 / 27), "signal": (9, 2 / 10), "range": (14, 1 / 14)}
STATE = (
    "instrument_id string, n_rows bigint, last_date date, "
    "tail array<struct<trade_date: date, open: double, high: double, low: double, close: double, volume: double>>, "
    "smoothings map<string, struct<seed: array<double>, value: double, ended: boolean>>, last_line double, last_signal double"
)
VALUES = "instrument_id string, trade_date date, signal_index bigint, " + ", ".join(f"{f} double" for f in FEATURES)


class NotLater(ValueError):
    """New bars that are not later than the state of their instrument, or that repeat a date."""


def _windowed(x: np.ndarray, n: int, how) -> np.ndarray:
    """``how`` over each full window of ``n`` values without a gap, else nan."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = how(sliding_window_view(x, n), axis=1)
    return out


def _back(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]))


def _frames(p: pd.DataFrame) -> dict[str, np.ndarray]:
    high, low, close, volume = (p[c].to_numpy(dtype=float) for c in ("high", "low", "close", "volume"))
    width = _windowed(high, 30, np.max) - _windowed(low, 30, np.min)
    return {
        "sma_50": _windowed(close, 50, np.mean), "sma_200": _windowed(close, 200, np.mean), "atr_14": _windowed(rec.true_ranges(p), 14, np.mean), "return_60": close / _back(close, 60) - 1,
        "avg_dollar_volume_20": _windowed(close * volume, 20, np.mean), "rolling_range_pct_30": width / close * 100,
    }


def stepped(state: dict[str, Any] | None, new: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, Any]]:
    """(features of the new bars, next state) of one instrument; ``state`` as a row of ``STATE`` without the id, or None."""
    state = state or {"n_rows": 0, "last_date": None, "tail": [], "smoothings": {}, "last_line": None, "last_signal": None}
    new = new.sort_values("trade_date", ignore_index=True)[BAR]
    if new["trade_date"].duplicated().any():
        raise NotLater("a date occurs twice among the new bars")
    if state["last_date"] is not None and len(new) and new["trade_date"].iloc[0] <= state["last_date"]:
        raise NotLater(f"a bar of {new['trade_date'].iloc[0]} is not later than {state['last_date']}")
    tail = pd.DataFrame([dict(r) for r in state["tail"]], columns=BAR)
    p = pd.concat([x for x in (tail, new) if len(x)], ignore_index=True) if len(tail) or len(new) else new
    known, k = len(tail), len(new)
    out = pd.DataFrame({"trade_date": new["trade_date"], "signal_index": state["n_rows"] + np.arange(k)})
    for name, values in _frames(p).items():
        out[name] = values[known:]

    smoothings = {}

    def smooth(name: str, x: np.ndarray) -> np.ndarray:
        n, weight = SMOOTHINGS[name]
        old = state["smoothings"].get(name)
        was = rec.Smoothing(tuple(old["seed"]), old["value"], old["ended"]) if old else rec.Smoothing()
        values, now = rec.smoothed(x, n, weight, "reset", was)
        smoothings[name] = {"seed": list(now.seed), "value": now.value, "ended": now.ended}
        return values

    close = new["close"].to_numpy(dtype=float)
    move = np.diff(p["close"].to_numpy(dtype=float), prepend=np.nan)[known:]
    out["rsi_14"] = rec.rsi_from(smooth("up", np.maximum(move, 0)), smooth("down", np.maximum(-move, 0)))
    line = smooth("fast", close) - smooth("slow", close)
    signal = smooth("signal", line)
    out["macd_line_pct"], out["macd_signal_pct"], out["macd_histogram_pct"] = line / close * 100, signal / close * 100, (line - signal) / close * 100
    before = lambda x, last: np.concatenate(([np.nan if last is None else last], x))
    out["macd_bullish_cross"] = rec.crossed(before(line, state["last_line"]), before(signal, state["last_signal"]))[1:]
    out["atr_wilder_pct_14"] = smooth("range", rec.true_ranges(p)[known:]) / close * 100
    last = lambda x, old: old if not k else None if np.isnan(x[-1]) else float(x[-1])
    kept = p.iloc[-TAIL:].astype(object).where(p.iloc[-TAIL:].notna(), None)
    follow = {
        "n_rows": state["n_rows"] + k, "last_date": new["trade_date"].iloc[-1] if k else state["last_date"], "tail": kept.to_dict("records"),
        "smoothings": smoothings, "last_line": last(line, state["last_line"]), "last_signal": last(signal, state["last_signal"]),
    }
    return out, follow


def _plain(value: Any) -> Any:
    """A cell of a pandas frame as plain Python values: Arrow hands arrays, and maps as lists of pairs."""
    if isinstance(value, np.ndarray | list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return None if isinstance(value, float) and np.isnan(value) else value


def _state_of(row: pd.Series) -> dict[str, Any]:
    got = {c: _plain(row[c]) for c in ("n_rows", "last_date", "tail", "smoothings", "last_line", "last_signal")}
    got["smoothings"] = got["smoothings"] if isinstance(got["smoothings"], dict) else dict(got["smoothings"])
    return got | {"n_rows": int(got["n_rows"])}


def advance(states: DataFrame, new: DataFrame) -> DataFrame:
    """One step for all instruments: rows with the features of new bars, and one row an instrument with its next ``state``.

    ``states`` has the columns of ``STATE`` (none for the first step), ``new`` bars. Features have a null ``state``,
    state rows a null trade_date; stage the result and read both off it. An instrument without new bars keeps its
    state. Bars that are not later than the state, or that repeat a date, fail the job.
    """
    names = [f.split()[0] for f in VALUES.split(", ")]
    fields = ["n_rows", "last_date", "tail", "smoothings", "last_line", "last_signal"]

    def run(key: tuple, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out, state = stepped(_state_of(old.iloc[0]) if len(old) else None, rows)
        out.insert(0, "instrument_id", key[0])
        out["state"] = None
        last = {n: None for n in names} | {"instrument_id": key[0], "state": {f: state[f] for f in fields}}
        out = out.astype(object).where(out.notna(), None)
        return pd.DataFrame([*out.to_dict("records"), last], columns=[*names, "state"])

    body = STATE.split(", ", 1)[1]
    saved = "struct<" + body.replace("n_rows bigint", "n_rows: bigint").replace("last_date date", "last_date: date").replace("tail array", "tail: array").replace("smoothings map", "smoothings: map").replace("last_line double", "last_line: double").replace("last_signal double", "last_signal: double") + ">"
    bars = new.select("instrument_id", *[F.col(c) if c == "trade_date" else F.col(c).cast("double") for c in BAR])
    return states.groupBy("instrument_id").cogroup(bars.groupBy("instrument_id")).applyInPandas(run, f"{VALUES}, state {saved}")


class FeatureLog:
    """Features under ``path``, a folder a batch, with the state that the next batch starts from.

    A batch is written aside and committed by one rename under its number, features and state together. A number
    that is committed already is passed over, so a batch may be sent again after a failure.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names("log") if n.startswith("batch="))

    def state(self) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.parquet(self.folder.path(f"log/batch={done[-1]}/step")).where("state is not null").select("instrument_id", "state.*")

    def append(self, new: DataFrame, number: int) -> bool:
        """Advance by the bars of batch ``number``; False if it was there already. Numbers must rise."""
        done = self.batches()
        if number in done:
            return False
        if done and number < done[-1]:
            raise NotLater(f"batch {number} after batch {done[-1]}")
        pending = self.folder.scratch(f"batch-{number}")
        advance(self.state(), new).write.parquet(self.folder.path(f"{pending}/step"))
        self.folder.commit(pending, f"log/batch={number}")
        return True

    def features(self) -> DataFrame:
        paths = [self.folder.path(f"log/batch={n}/step") for n in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], VALUES)
        return self.spark.read.parquet(*paths).where("state is null").drop("state")


def parts(bars: DataFrame, cuts: list[str]) -> Iterator[DataFrame]:
    """``bars`` in pieces by date, each from one cut up to the next."""
    edges = [None, *cuts, None]
    for a, b in zip(edges, edges[1:], strict=False):
        part = bars
        if a:
            part = part.where(F.col("trade_date") >= F.lit(a).cast("date"))
        if b:
            part = part.where(F.col("trade_date") < F.lit(b).cast("date"))
        yield part
