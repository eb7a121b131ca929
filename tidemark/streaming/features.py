"""Features as a stream: typed state of an instrument, advanced by each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

import tidemark
from tidemark.operators.incremental import BAR, VALUES, stepped

_STATE = "n_rows bigint, last_date date, last_line double, last_signal double"
_BAR = "trade_date date, open double, high double, low double, close double, volume double"
_SMOOTHING = "seed array<double>, value double, ended boolean"


class _Advance(StatefulProcessor):
    """A value for the counters, a list for the last bars and a map for the smoothings of each instrument."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", _STATE)
        self.tail = handle.getListState("tail", _BAR)
        self.smoothings = handle.getMapState("smoothings", "name string", _SMOOTHING)

    def _saved(self) -> dict[str, Any] | None:
        if not self.head.exists():
            return None
        rows, last, line, signal = self.head.get()
        smoothings = {k[0]: {"seed": list(v[0]), "value": v[1], "ended": v[2]} for k, v in self.smoothings.iterator()}
        return {"n_rows": rows, "last_date": last, "tail": [dict(zip(BAR, r, strict=True)) for r in self.tail.get()], "smoothings": smoothings, "last_line": line, "last_signal": signal}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        out, state = stepped(self._saved(), pd.concat(list(rows), ignore_index=True))
        self.head.update((state["n_rows"], state["last_date"], state["last_line"], state["last_signal"]))
        self.tail.put([tuple(r[c] for c in BAR) for r in state["tail"]])
        for name, s in state["smoothings"].items():
            self.smoothings.updateValue((name,), (s["seed"], s["value"], s["ended"]))
        out.insert(0, "instrument_id", key[0])
        yield out

    def close(self) -> None:
        pass


def feature_stream(bars: DataFrame) -> DataFrame:
    """Features of a stream of bars that arrive in date order, each instrument's from its own state.

    A bar that is not later than the last of its instrument fails the query. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    # the process in which Spark calls ``init`` does not have the package that was shipped to the workers
    cloudpickle.register_pickle_by_value(tidemark)
    try:
        return bars.select("instrument_id", *BAR).groupBy("instrument_id").transformWithStateInPandas(_Advance(), VALUES, "Append", "None")
    finally:
        cloudpickle.unregister_pickle_by_value(tidemark)
