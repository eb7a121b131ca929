"""Consolidation patterns: trend filters, qualified bases, breakouts with cooldown, the life cycle of a base."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import before, full, sma
from tidemark.operators.outcomes import stride, usable

TRENDS = ("NONE", "ABOVE_SMA_200", "ABOVE_RISING_SMA_200", "ABOVE_ALL", "STACKED")


def by_window():
    return Window.partitionBy("instrument_id").orderBy("trade_date")


def with_trends(bars: DataFrame) -> DataFrame:
    for n in (50, 100, 200):
        bars = bars.withColumn(f"sma_{n}", sma(F.col("close"), n))
    return bars.withColumn("sma_200_then", before(F.col("sma_200"), 20))


def trend_ok(name: str) -> Column:
    """Needs the columns of :func:`with_trends`; unknown means no."""
    c, s50, s100, s200 = (F.col(x) for x in ("close", "sma_50", "sma_100", "sma_200"))
    rule = {
        "NONE": F.lit(True),
        "ABOVE_SMA_200": c > s200,
        "ABOVE_RISING_SMA_200": (c > s200) & (s200 > F.col("sma_200_then")),
        "ABOVE_ALL": (c > s50) & (c > s100) & (c > s200),
        "STACKED": (c > s50) & (s50 > s100) & (s100 > s200),
    }[name]
    return F.coalesce(rule, F.lit(False))


def trend_candidates(bars: DataFrame, trend: str) -> DataFrame:
    """Bars whose trend holds, the last one of each instrument left out, as nothing can be entered behind it."""
    last = F.max("signal_index").over(Window.partitionBy("instrument_id"))
    return with_trends(bars).withColumn("last_index", last).where(trend_ok(trend) & (F.col("signal_index") < F.col("last_index"))).drop("last_index")


def trend_contexts(bars: DataFrame, benchmark: DataFrame, slope: int = 20, trailing: int = 60) -> DataFrame:
    """Contexts T0 to T6 of each bar. ``benchmark`` has (trade_date, benchmark_close); T6 compares on the stock's dates."""
    df = with_trends(bars).withColumn("slope_then", before(F.col("sma_200"), slope))
    df = df.withColumn("then_date", F.lag("trade_date", trailing).over(Window.partitionBy("instrument_id").orderBy("trade_date"))).withColumn("trail", F.col("close") / before(F.col("close"), trailing) - 1)
    now = benchmark.select("trade_date", F.col("benchmark_close").alias("b1"))
    then = benchmark.select(F.col("trade_date").alias("then_date"), F.col("benchmark_close").alias("b0"))
    df = df.join(now, "trade_date", "left").join(then, "then_date", "left").withColumn("relative", F.col("trail") - (F.col("b1") / F.col("b0") - 1))
    c = F.col("close")
    t1 = c > F.col("sma_200")
    t2 = t1 & (F.col("sma_200") > F.col("slope_then"))
    t3 = t1 & (c > F.col("sma_50"))
    rules = {"t0": F.lit(True), "t1": t1, "t2": t2, "t3": t3, "t4": t3 & (F.col("sma_50") > F.col("sma_200")), "t5": t2 & (F.col("trail") > 0), "t6": t2 & (F.col("relative") > 0)}
    return df.select("instrument_id", "trade_date", *[F.coalesce(x, F.lit(False)).alias(k) for k, x in rules.items()])


def bases(bars: DataFrame, duration: int, max_range: float, trend: str) -> DataFrame:
    """Bars with the base before them: resistance, support, and ``qualified``. Ranges are compared in cents."""
    frame = Window.partitionBy("instrument_id").orderBy("trade_date").rowsBetween(-duration, -1)
    percent = round(max_range * 100)
    df = with_trends(bars).withColumn("hc_most", full(F.max, F.col("hc"), duration, -1)).withColumn("lc_least", full(F.min, F.col("lc"), duration, -1))
    df = df.withColumn("base_ok", F.coalesce(F.min(usable().cast("int")).over(frame) == 1, F.lit(False)) & usable())
    tight = (F.col("hc_most") - F.col("lc_least")) * 100 <= percent * F.col("lc_least")
    return df.withColumn("qualified", F.coalesce(tight, F.lit(False)) & F.col("base_ok") & trend_ok(trend))


def breakouts(bars: DataFrame, duration: int = 20, max_range: float = 0.08, trend: str = "NONE", cooldown: int = 5, volume_ratio: float | None = None) -> DataFrame:
    """Closes above the resistance of a qualified base, thinned by a greedy cooldown."""
    df = bases(bars, duration, max_range, trend).withColumn("ratio", F.col("volume") / full(F.avg, F.col("volume"), 20, -1))
    hit = F.col("qualified") & (F.col("cc") > F.col("hc_most"))
    if volume_ratio is not None:
        hit = hit & F.coalesce(F.col("ratio") >= volume_ratio, F.lit(False))
    return stride(df.where(hit), cooldown, strict=True)


@dataclass(frozen=True)
class Lifecycle:
    """Settings of the life cycle of a base and of the events that close it."""

    duration: int = 20
    max_range_pct: int = 8
    trigger_distance: float = 0.02
    max_age: int | None = None
    reset_sessions: int = 5
    trend: str = "NONE"
    #: Sessions that an event keeps the next one away, and the volume that it needs against the 20 sessions before.
    cooldown: int = 5
    volume_ratio: float | None = None


class Tracker:
    """The state of one instrument's base; ``step`` takes its bars one by one and says what holds after each.

    The geometry is frozen when a base first qualifies. Reasons to end it are looked at in a fixed order from the
    next bar on; a new base may begin only behind the last end, and not overlap it. A close above the
    resistance of a base that holds is an event unless the last event is too near or the volume too low; then the
    base goes on, and only an event consumes it. A corporate action without a base counts as an end too. Extremes
    are kept as numbers and the base in a window, so a step costs no more as the series grows.
    """

    def __init__(self, settings: Lifecycle, saved: dict | None = None):
        self.s = settings
        self.state: dict = saved or {"bars": [], "active": None, "last_index": None, "ended_at": None, "ended_date": None, "event_at": None}

    def step(self, bar: dict) -> dict:
        """What holds after ``bar`` (index, date, hc, lc, cc, ok, trend_ok, action, ratio). An older bar raises.

        state, reason, event, and of the base resistance, support and the date it began, if there is one.
        """
        st, s = self.state, self.s
        if st["last_index"] is not None and bar["index"] <= st["last_index"]:
            raise ValueError("bars must come in order")
        base = st["bars"][-s.duration :]
        st["last_index"] = bar["index"]
        st["bars"] = [*st["bars"][-(s.duration - 1) :], {k: bar[k] for k in ("index", "date", "hc", "lc", "ok")}]
        held = st["active"]
        if held:
            held["high"], held["low"] = max(held["high"], bar["hc"]), min(held["low"], bar["lc"])
            if reason := self._broken(bar, held):
                return self._end(bar, held, "INVALIDATED", reason)
        elif bar.get("action"):
            st |= {"ended_at": bar["index"], "ended_date": bar["date"]}
        else:
            held = st["active"] = self._begun(bar, base)
        if not held:
            return {"state": "NONE", "reason": "", "event": False, "resistance": None, "support": None, "began": None}
        if self._confirmed(bar, held):
            st["event_at"] = bar["index"]
            return self._end(bar, held, "CONSUMED", "BREAKOUT", True)
        away = (held["resistance"] - bar["cc"]) / held["resistance"]
        return self._out(held, "TRIGGER_READY" if 0 <= away <= s.trigger_distance else "QUALIFIED", "")

    def _begun(self, bar: dict, base: list[dict]) -> dict | None:
        st, s = self.state, self.s
        if len(base) < s.duration or not all(b["ok"] for b in base) or not bar["ok"] or not bar["trend_ok"]:
            return None
        if st["ended_at"] is not None and (bar["index"] - st["ended_at"] <= s.reset_sessions or base[0]["date"] <= st["ended_date"]):
            return None
        high, low = max(b["hc"] for b in base), min(b["lc"] for b in base)
        if (high - low) * 100 > s.max_range_pct * low:
            return None
        return {"ends": base[-1]["index"], "began": base[0]["date"], "resistance": high, "support": low, "high": max(high, bar["hc"]), "low": min(low, bar["lc"])}

    def _broken(self, bar: dict, held: dict) -> str:
        s = self.s
        if bar.get("action"):
            return "corporate_action_discontinuity"
        if not bar["ok"]:
            return "data_quality_or_eligibility"
        if not bar["trend_ok"]:
            return "trend_context_failed"
        if bar["cc"] < held["support"]:
            return "closed_below_support"
        if s.max_age is not None and bar["index"] - held["ends"] > s.max_age:
            return "maximum_age_exceeded"
        wide = (held["high"] - held["low"]) * 100 > s.max_range_pct * held["low"]
        return "range_expanded_beyond_limit" if wide and bar["cc"] <= held["resistance"] else ""

    def _confirmed(self, bar: dict, held: dict) -> bool:
        s, last, ratio = self.s, self.state["event_at"], bar.get("ratio")
        rested = last is None or bar["index"] - last > s.cooldown
        loud = s.volume_ratio is None or (ratio is not None and ratio >= s.volume_ratio)
        return rested and loud and bar["ok"] and bar["cc"] > held["resistance"]

    @staticmethod
    def _out(held: dict, state: str, reason: str, event: bool = False) -> dict:
        return {"state": state, "reason": reason, "event": event, "resistance": held["resistance"], "support": held["support"], "began": held["began"]}

    def _end(self, bar: dict, held: dict, state: str, reason: str, event: bool = False) -> dict:
        self.state |= {"active": None, "ended_at": bar["index"], "ended_date": bar["date"]}
        return self._out(held, state, reason, event)


STATE_SCHEMA = "instrument_id string, trade_date date, signal_index bigint, state string, reason string, event boolean, resistance bigint, support bigint, began string, cc bigint, ratio double"


def tracker_input(bars: DataFrame, settings: Lifecycle, actions: DataFrame | None = None) -> DataFrame:
    """What the tracker looks at; ``actions`` has (instrument_id, effective_date)."""
    df = with_trends(bars)
    usual = full(F.avg, F.col("volume"), 20, -1)
    df = df.withColumn("ratio", F.when(usual > 0, F.col("volume") / usual))
    if actions is None:
        df = df.withColumn("action", F.lit(False))
    else:
        own = actions.select("instrument_id", F.col("effective_date").alias("trade_date"), F.lit(True).alias("action")).distinct()
        df = df.join(own, ["instrument_id", "trade_date"], "left").withColumn("action", F.coalesce("action", F.lit(False)))
    return df.select("instrument_id", "trade_date", F.col("signal_index").cast("bigint").alias("signal_index"), "hc", "lc", "cc", usable().alias("ok"), trend_ok(settings.trend).alias("trend_ok"), "action", "ratio")


def run_tracker(tracker: Tracker, p: pd.DataFrame) -> pd.DataFrame:
    p = p.sort_values("signal_index", ignore_index=True)
    ratios = [None if r != r else r for r in p["ratio"]]
    got = [
        tracker.step({"index": r.signal_index, "date": str(r.trade_date), "hc": r.hc, "lc": r.lc, "cc": r.cc, "ok": bool(r.ok), "trend_ok": bool(r.trend_ok), "action": bool(r.action), "ratio": ratio})
        for r, ratio in zip(p.itertuples(), ratios, strict=True)
    ]
    found = pd.DataFrame(got, columns=["state", "reason", "event", "resistance", "support", "began"]).astype({"resistance": "Int64", "support": "Int64"})
    return pd.concat([p[["instrument_id", "trade_date", "signal_index"]], found, p[["cc", "ratio"]]], axis=1)


def lifecycle_states(bars: DataFrame, settings: Lifecycle | None = None, actions: DataFrame | None = None) -> DataFrame:
    """State and reason after every bar, and the events; a group is one instrument's daily series."""
    settings = settings or Lifecycle()
    return tracker_input(bars, settings, actions).groupBy("instrument_id").applyInPandas(lambda p: run_tracker(Tracker(settings), p), STATE_SCHEMA)


def lifecycle_events(states: DataFrame) -> DataFrame:
    """The events with an id made of the instrument, the base's first day and the signal day."""
    own = F.concat_ws(":", "instrument_id", "began", F.col("trade_date").cast("string"))
    return states.where("event").select(own.alias("event_id"), "instrument_id", "trade_date", "signal_index", F.col("resistance").alias("trigger_boundary"), F.col("cc").alias("trigger_value"), "ratio")


def projection(states: DataFrame, settings: Lifecycle | None = None, as_of: str | None = None) -> DataFrame:
    """Each instrument at its last bar up to ``as_of``: one of eight statuses, and the distance to the trigger."""
    s = settings or Lifecycle()
    rows = states if as_of is None else states.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    names = ("trade_date", "state", "reason", "event", "resistance", "cc", "ratio")
    last = rows.groupBy("instrument_id").agg(F.max_by(F.struct(*names), "trade_date").alias("x")).select("instrument_id", "x.*")
    quiet = F.lit(False) if s.volume_ratio is None else ~F.coalesce(F.col("ratio") >= s.volume_ratio, F.lit(False))
    ended = F.when(F.col("reason") == "data_quality_or_eligibility", "QUALITY_BLOCKED").when(F.col("reason") == "trend_context_failed", "TREND_FILTER_FAIL").otherwise("INVALIDATED")
    status = F.when(F.col("event"), "BREAKOUT").when(F.col("state") == "NONE", "INACTIVE").when(F.col("state") == "INVALIDATED", ended)
    status = status.when((F.col("cc") > F.col("resistance")) & quiet, "VOLUME_FILTER_FAIL").when(F.col("state") == "TRIGGER_READY", "TRIGGER_READY").otherwise("STRUCTURE_ACTIVE")
    away = (F.col("resistance") - F.col("cc")) / F.col("resistance")
    return last.select("instrument_id", "trade_date", status.alias("status"), "state", "reason", F.col("resistance").alias("trigger_boundary"), F.round(away, 8).alias("distance_to_trigger"), F.round("ratio", 8).alias("volume_ratio"))


def latest_states(states: DataFrame, as_of: str | None = None) -> DataFrame:
    """Each instrument's state at its last bar up to ``as_of``."""
    rows = states if as_of is None else states.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    return rows.groupBy("instrument_id").agg(F.max_by(F.struct("trade_date", "state", "reason"), "trade_date").alias("x")).select("instrument_id", "x.*")


STATES = ("NONE", "QUALIFIED", "TRIGGER_READY", "INVALIDATED", "CONSUMED")


def state_counts(latest: DataFrame) -> DataFrame:
    """Instruments by state, states without any included."""
    every = latest.sparkSession.createDataFrame([(x,) for x in STATES], "state string")
    return every.join(latest.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
