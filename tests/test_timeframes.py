"""Block bars, signals moved to days, thinning in linear work, the reading of a response, and draws that can be replayed."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.functions.permutation import permuted
from tidemark.operators import outcomes as oc
from tidemark.operators import statistics as st
from tidemark.operators import timeframes as tf
from tidemark.plans.research import ancestors


def daily(spark, *series):
    """Bars of (instrument, first day, closes, {position: (eligibility, quality)})."""
    rows = []
    for name, first, closes, odd in series:
        day, d = 0, date.fromisoformat(first)
        for c in closes:
            while d.weekday() > 4:
                d += timedelta(1)
            if c is not None:
                ok, q = odd.get(day, (True, "PASS"))
                cents = round(c * 100)
                rows.append((name, d, float(c), c + 1.0, c - 1.0, float(c), 10.0, cents, cents + 100, cents - 100, cents, ok, q, "v1"))
            day, d = day + 1, d + timedelta(1)
    df = spark.createDataFrame(rows, "instrument_id string, trade_date date, open double, high double, low double, close double, volume double, oc bigint, hc bigint, lc bigint, cc bigint, eligibility boolean, quality_status string, dataset_version string")
    from tidemark.sources.bars import by_date

    return df.withColumn("signal_index", F.row_number().over(by_date()) - 1)


def test_block_bars_carry_the_worst_of_their_days(spark):
    bars = daily(spark, ("A", "2024-01-01", [1, 2, 3, 4, 5, 6, 7], {1: (True, "WARN"), 2: (False, "PASS"), 5: (True, "QUARANTINE")}), ("B", "2024-01-01", [1, 2, None, 4, 5, 6, 7], {}))
    got = {(r.instrument_id, r.signal_index): r for r in tf.block_bars(bars, 2).collect()}
    a = [got["A", i] for i in range(3)]
    assert [(r.open, r.close, r.hc, r.lc, r.volume, r.source_start, r.source_end) for r in a] == [(1, 2, 300, 0, 20, 0, 1), (3, 4, 500, 200, 20, 2, 3), (5, 6, 700, 400, 20, 4, 5)]
    assert [(r.eligibility, r.quality_status) for r in a] == [(True, "WARN"), (False, "PASS"), (True, "QUARANTINE")]
    # B lacks the third session, so it has no second block, and its third block is its second bar
    assert [(got["B", i].source_start, got["B", i].source_end) for i in range(2)] == [(0, 1), (3, 4)] and ("B", 2) not in got
    weekly = tf.block_bars(bars, None).collect()
    assert [(r.instrument_id, r.source_end) for r in weekly] == [("A", 4)]  # B's week lacks a day, the last week has no Friday
    with pytest.raises(Exception, match="several dataset versions"):
        tf.block_bars(bars.withColumn("dataset_version", F.when(F.col("signal_index") == 1, "v2").otherwise("v1")), 2).collect()


def test_events_move_to_the_last_day_of_their_block(spark):
    bars = daily(spark, ("A", "2024-01-01", [1, 2, 3, 4, 5, 6, 7], {}), ("B", "2024-01-02", [1, 2, None, 4], {}))
    rows = spark.createDataFrame([("A", date(2024, 1, 4), 1), ("B", date(2024, 1, 4), 0), ("B", date(2024, 1, 20), 9)], "instrument_id string, trade_date date, block_index int")
    got = sorted((r.instrument_id, r.signal_index, r.block_index, r.event_id) for r in tf.to_daily(rows, bars, "weekly").collect())
    assert got == [("A", 3, 1, "A:2024-01-04:pattern_timeframe=weekly"), ("B", 1, 0, "B:2024-01-04:pattern_timeframe=weekly"), ("B", 2, 9, "B:2024-01-20:pattern_timeframe=weekly")]
    early = spark.createDataFrame([("B", date(2024, 1, 1), 0)], rows.schema)
    with pytest.raises(Exception, match="before the first bar"):
        tf.to_daily(early, bars, "weekly").collect()


# ---- thinning


def fold(positions, gap):
    out, last = [], -10_000
    for p in sorted(set(positions)):
        if p - last >= gap:
            out.append(p)
            last = p
    return out


def test_thinning_equals_the_fold(spark):
    rng = np.random.default_rng(1)
    for _ in range(200):
        positions = np.unique(rng.integers(0, 200, rng.integers(0, 80)))
        for gap in (1, 2, 7, 300):
            assert oc.taken(positions, gap).tolist() == fold(positions.tolist(), gap)
    rows = spark.range(20_000).select((F.col("id") % 5).cast("string").alias("instrument_id"), (F.xxhash64("id") % 10 > 4).alias("side"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000)).alias("at"))
    got: dict = {}
    for r in oc.stride(rows, 5, by=("instrument_id", "side"), position="at").select("instrument_id", "side", "at").distinct().collect():
        got.setdefault((r.instrument_id, r.side), []).append(r.at)
    want: dict = {}
    for r in rows.collect():
        want.setdefault((r.instrument_id, r.side), []).append(r.at)
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(v, 5) for k, v in want.items()}


def test_a_million_positions_in_one_series(spark):
    rows = spark.range(1_000_000).select(F.lit("A").alias("instrument_id"), F.col("id").alias("signal_index"))
    assert oc.stride(rows, 5).count() == 200_000 and oc.stride(rows, 5, strict=True).count() == math.ceil(1_000_000 / 6)


def test_baselines_of_entries_and_of_paths(spark):
    bars = daily(spark, ("A", "2024-01-01", list(range(10, 30)), {3: (True, "QUARANTINE"), 12: (False, "PASS")}))
    signals = bars.select("instrument_id", "signal_index")
    ok = lambda i: i not in (3, 12)
    close = lambda i: 10.0 + i
    entries = fold([i for i in range(19) if ok(i) and ok(i + 1)], 5)
    whole = lambda i, h: i + h < 20 and all(ok(j) for j in range(i + 1, i + h + 1))
    got = sorted((r.signal_index, r.horizon, r.forward_return) for r in oc.baseline(bars, signals, (2, 4), 5).collect())
    assert got == sorted((i, h, close(i + h) / close(i + 1) - 1) for i in entries for h in (2, 4) if whole(i, h))
    paths = fold([i for i in range(19) if ok(i) and ok(i + 1) and whole(i, 4)], 5)
    assert sorted(r.signal_index for r in oc.baseline(bars, signals, (4,), 5, "path").collect()) == paths != entries
    blocks = signals.where("signal_index % 2 = 1").withColumn("block", F.floor(F.col("signal_index") / 2))
    odd = fold([i // 2 for i in range(1, 19, 2) if ok(i) and ok(i + 1) and whole(i, 2)], 2)
    assert sorted(r.signal_index for r in oc.baseline(bars, blocks, (2,), 2, "path", "block").collect()) == [2 * b + 1 for b in odd]
    with pytest.raises(ValueError):
        oc.baseline(bars, signals, (2, 4), 5, "path")


# ---- the reading of a response


def plain_reading(points):
    points = sorted((v, e) for v, e in points if e is not None)
    if len(points) < 3:
        return ("insufficient",)
    es = [e for _, e in points]
    diffs, spread = np.diff(es), max(es) - min(es)
    flat, most = max(1e-12, 0.08 * spread), max(1, (4 * (len(es) - 1) + 4) // 5)
    shape = "increasing" if (diffs >= -flat).sum() >= most and es[-1] > es[0] + flat else "decreasing" if (diffs <= flat).sum() >= most and es[-1] < es[0] - flat else "mixed"
    best = es.index(max(es))
    near = [e >= max(es) - max(0.005, 0.12 * spread) for e in es]
    lo = hi = best
    while lo and near[lo - 1]:
        lo -= 1
    while hi + 1 < len(es) and near[hi + 1]:
        hi += 1
    vs = [v for v, _ in points]
    step = float(np.median(np.diff(vs)))
    reach = max(max(vs[-1] - vs[0], 4 * step), 5 * step)
    if shape == "increasing" and best == len(es) - 1:
        goes = (vs[-1], vs[-1] + reach)
    elif shape == "decreasing" and best == 0:
        goes = (max(0.0, vs[0] - reach), vs[0])
    else:
        goes = (vs[max(0, best - 1)], vs[min(len(vs) - 1, best + 1)])
    return (shape, vs[best], es[best], vs[lo], vs[hi], hi - lo + 1, *goes)


def test_response_shape(spark):
    rng = np.random.default_rng(6)
    groups = [[(v, v * 0.01) for v in (1.0, 2.0, 3.0, 5.0)], [(v, -v * 0.02) for v in range(1, 8)], [(1.0, 0.1), (2.0, None), (3.0, 0.2)], [(1.0, 0.1), (2.0, 0.1), (3.0, 0.1)], [(1.0, 0.0), (2.0, 0.3), (3.0, 0.29), (4.0, 0.0), (5.0, 0.3)]]
    groups += [[(float(v), round(float(e), 3)) for v, e in zip(rng.choice(50, n, replace=False), np.cumsum(rng.normal(0.01, 0.02, n)), strict=True)] for n in rng.integers(3, 9, 60)]
    rows = [(g, float(v), None if e is None else float(e)) for g, own in enumerate(groups) for v, e in own]
    got = {r.g: r for r in st.response_shape(spark.createDataFrame(rows, "g int, v double, e double"), ["g"], "v", "e").collect()}
    for g, own in enumerate(groups):
        want, r = plain_reading(own), got[g]
        mine = (r.shape, r.best_value, r.best_expectancy, r.plateau_low, r.plateau_high, r.plateau_cells, r.next_low, r.next_high)
        assert mine[: len(want)] == pytest.approx(want, nan_ok=True) if len(want) == 1 else (mine[0] == want[0] and np.allclose(mine[1:], want[1:])), (g, own, mine, want)


# ---- draws


def test_keyed_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        images = {tuple(permuted(np.arange(n), n, key).tolist()) for key in range(30)}
        assert all(sorted(x) == list(range(n)) for x in images) and (n < 16 or len(images) == 30)
    first = np.array([permuted(np.arange(1), 10, k)[0] for k in range(20_000)])
    assert np.abs(np.bincount(first, minlength=10) / 20_000 - 0.1).max() < 0.01
    pairs = np.array([permuted(np.arange(2), 10, k) for k in range(20_000)])
    assert np.abs(np.bincount(pairs[:, 0] * 10 + pairs[:, 1], minlength=100).reshape(10, 10)[~np.eye(10, dtype=bool)] / 20_000 - 1 / 90).max() < 0.004


def test_random_timing_equals_a_replay(spark):
    rng = np.random.default_rng(7)
    pool = {i: rng.normal(0, 0.05, n) for i, n in (("A", 300), ("B", 40), ("C", 10))}
    take = {"A": 12, "B": 40, "C": 3}
    candidates = spark.createDataFrame([(i, n, float(x)) for i, xs in pool.items() for n, x in enumerate(xs)], "instrument_id string, signal_index int, forward_return double")
    events = candidates.where(" or ".join(f"(instrument_id = '{i}' and signal_index < {n})" for i, n in take.items()))
    got = st.random_timing(events.repartition(3), candidates.repartition(5), 250, 11).first()
    means = []
    for it in range(250):
        drawn = [pool[i][permuted(np.arange(n), len(pool[i]), st._draw_key(11, it, i))] for i, n in take.items()]
        means.append(np.concatenate(drawn).mean())
    observed = np.concatenate([pool[i][:n] for i, n in take.items()]).mean()
    assert got.iterations == 250 and got.sample_size == 55 and got.eligible == 350 and math.isclose(got.observed, observed) and math.isclose(got.null_mean, np.mean(means))
    assert math.isclose(got.p_value, (1 + sum(m >= observed for m in means)) / 251) and math.isclose(got.null_low, np.quantile(means, 0.025)) and math.isclose(got.null_high, np.quantile(means, 0.975))
    with pytest.raises(Exception, match="candidates for"):
        st.random_timing(events, candidates.where("signal_index > 5"), 100, 11).collect()


def unit(*parts) -> float:
    """The library's hash of numbers and strings, in Python: each part's hash is the seed of the next one's."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else int(p[0]).to_bytes(4, "little", signed=True) if isinstance(p, tuple) else int(p).to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, seed=h)
    return (h & ((1 << 53) - 1)) / (1 << 53)


def test_bootstrap_and_flips_equal_a_replay(spark):
    rng = np.random.default_rng(8)
    months = [(f"2024-{m:02d}", float(t), int(n)) for m, t, n in zip(range(1, 10), rng.normal(0, 1, 9), rng.integers(1, 9, 9), strict=True)]
    df = spark.createDataFrame(months, "month string, total double, n bigint")
    got = st.month_bootstrap(df, 120, 5).first()
    means = []
    for it in range(120):
        drawn = [months[int(unit((5,), it, (d,)) * 9)] for d in range(9)]
        means.append(sum(t for _, t, _ in drawn) / sum(n for _, _, n in drawn))
    assert math.isclose(got.low, np.quantile(means, 0.025)) and math.isclose(got.high, np.quantile(means, 0.975))
    gaps = df.select("month", (F.col("total") / F.col("n")).alias("gap"))
    values = [t / n for _, t, n in months]
    flips = [np.mean([-g if unit((3,), it, m) < 0.5 else g for (m, _, _), g in zip(months, values, strict=True)]) for it in range(150)]
    got = st.sign_flip(gaps, 150, 3).first()
    assert math.isclose(got.p_value, (1 + sum(abs(x) >= abs(np.mean(values)) - 1e-15 for x in flips)) / 151)


# ---- ancestors


def test_ancestors_of_any_depth_and_cycles(spark):
    chain = spark.range(1, 90).select(F.col("id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"))
    got = ancestors(chain)
    assert got.count() == 89 * 88 // 2 and got.agg(F.max("depth")).first()[0] == 88
    assert ancestors(chain.where("id = 1")).count() == 0
    with pytest.raises(ValueError, match="own ancestor"):
        ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id bigint, parent bigint"))
    with pytest.raises(ValueError, match="several parents"):
        ancestors(spark.createDataFrame([(1, 2), (1, 3)], "id bigint, parent bigint"))


def test_ancestors_climb_several_levels_a_round(spark):
    """Sixteen levels take four rounds of four, whatever the shape: chains that end inside a round, at its end, and in a cycle longer than a round."""
    from pathlib import Path

    from tidemark.plans.research import ancestors

    links = [(i, i - 1) for i in range(1, 17)] + [(104, 103), (103, 102), (102, 101), (101, 100)] + [(200, 7)]
    df = spark.createDataFrame(links, "id bigint, parent bigint")
    parent, want = dict(links), []
    for i in parent:
        at, depth = i, 0
        while at in parent:
            at, depth = parent[at], depth + 1
            want.append((i, at, depth))
    got = ancestors(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({Path(f).parent.name for f in got.inputFiles()}) <= 5
    with pytest.raises(ValueError, match="its own ancestor"):
        ancestors(spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(9, 0)], "id bigint, parent bigint"))
