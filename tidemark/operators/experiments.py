"""The trend baseline: what following bars of each trend context, thinned, was worth over many horizons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.outcomes import stride

# Contexts, and the horizons and the stride of the experiment.
CONTEXTS = ("t0", "t1", "t2", "t3", "t4", "t5", "t6")
HORIZONS, STRIDE = (5, 10, 20, 40, 60, 120, 252), 5
#: Paths that a kernel holds at once.
_PATHS = 512
_MEASURES = "instrument_id string, signal_index bigint, horizon int, forward_return double, mfe double, mae double, max_drawdown double"


def path_measures(bars: DataFrame, events: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Return, excursions and drawdown of ``events`` (instrument_id, signal_index) at each horizon that their path reaches over usable bars.

    Entry is the open of the next bar. The drawdown is that of a bar's low from the highest high so far, the bar's own and the
    entry included, and 0 at most. Measures of all horizons come from one running pass over a path; an instrument's series and
    events meet in one task, where paths are taken a bounded number at a time.
    """
    reach = max(horizons)

    def run(key: tuple, series: pa.Table, asked: pa.Table) -> pa.Table:
        at = series["signal_index"].to_numpy()
        order = np.argsort(at)
        at = at[order]
        ok, opened, high, low, close = (series[c].to_numpy()[order] for c in ("ok", "open", "high", "low", "close"))
        pad = lambda x: np.concatenate((x, np.full(reach, np.nan)))
        good, high, low, close = pad(np.where(ok, 1.0, np.nan)), pad(high), pad(low), pad(close)
        places = np.searchsorted(at, np.unique(asked["position"].to_numpy()))
        places = places[places + 1 < len(at)]
        found = []
        for lo in range(0, len(places), _PATHS):
            own = places[lo : lo + _PATHS]
            walk = own[:, None] + 1 + np.arange(reach)
            entry = opened[own + 1][:, None]
            whole = np.logical_and.accumulate(good[walk] == 1, axis=1)
            top = np.maximum.accumulate(high[walk], axis=1)
            bottom = np.minimum.accumulate(low[walk], axis=1)
            fall = np.minimum(np.minimum.accumulate(low[walk] / np.maximum(top, entry) - 1, axis=1), 0)
            for h in horizons:
                n = np.flatnonzero(whole[:, h - 1])
                e = entry[n, 0]
                found.append((at[own[n]], np.full(len(n), h), close[walk[n, h - 1]] / e - 1, top[n, h - 1] / e - 1, bottom[n, h - 1] / e - 1, fall[n, h - 1]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 6
        kinds = (pa.int64(), pa.int32(), *[pa.float64()] * 4)
        names = [f.split()[0] for f in _MEASURES.split(", ")]
        return pa.table([pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *[pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    ok = (F.col("eligibility") & (F.col("quality_status") == "PASS")).alias("ok")
    series = bars.select("instrument_id", F.col("signal_index").cast("bigint").alias("signal_index"), ok, "open", "high", "low", "close")
    asked = events.select(F.col("instrument_id").alias("of"), F.col("signal_index").cast("bigint").alias("position"))
    return series.groupBy("instrument_id").cogroup(asked.groupBy("of")).applyInArrow(run, _MEASURES)


def trend_baseline(bars: DataFrame, contexts: DataFrame, horizons: Sequence[int] = HORIZONS, gap: int = STRIDE) -> DataFrame:
    """Per context and horizon: sample size, mean, median, positive share and median excursions and drawdown; and the context's signals and instruments.

    ``contexts`` has (instrument_id, trade_date) and a flag for each of ``CONTEXTS``. Usable signals are thinned in each context
    by itself; a path that several contexts share is measured once. A context and horizon without a path has a row of size 0.
    """
    position = bars.select("instrument_id", "trade_date", "signal_index", (F.col("eligibility") & (F.col("quality_status") == "PASS")).alias("ok"))
    flags = F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in CONTEXTS]))).alias("context")
    signals = contexts.join(position, ["instrument_id", "trade_date"]).select("instrument_id", "signal_index", "ok", flags)
    size = signals.groupBy("context").agg(F.count("*").alias("signals"), F.count_distinct("instrument_id").alias("instruments"))
    sampled = stride(signals.where("ok"), gap, by=("instrument_id", "context")).select("instrument_id", "context", F.col("signal_index").cast("bigint").alias("signal_index"))
    measured = path_measures(bars, sampled, horizons).join(sampled, ["instrument_id", "signal_index"])
    middle = lambda c: F.percentile(c, 0.5).alias(f"median_{c}")
    got = measured.groupBy("context", "horizon").agg(
        F.count("*").alias("sample_size"), F.avg("forward_return").alias("mean_return"), F.percentile("forward_return", 0.5).alias("median_return"), F.avg((F.col("forward_return") > 0).cast("double")).alias("positive_fraction"),
        middle("mfe"), middle("mae"), middle("max_drawdown"),
    )
    every = bars.sparkSession.createDataFrame([(c, h) for c in CONTEXTS for h in horizons], "context string, horizon int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = every.join(F.broadcast(size), "context", "left").join(got, ["context", "horizon"], "left")
    return rows.select("context", "horizon", zero("signals"), zero("instruments"), zero("sample_size"), "mean_return", "median_return", "positive_fraction", "median_mfe", "median_mae", "median_max_drawdown")
