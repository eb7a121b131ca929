"""Stores: what they refuse, what a stop leaves behind, and that data and manifests belong together."""

from __future__ import annotations

import json
import uuid
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators import composite as cp
from tidemark.operators import quality as ql
from tidemark.operators.numbering import numbered
from tidemark.sources import backfill as bf
from tidemark.sources import master as ms
from tidemark.sources.bars import canonical, derive_bars
from tidemark.sources.files import Folder
from tidemark.sources.store import Conflict, Snapshots, Store


def day(x: str | None):
    return date.fromisoformat(x) if x else None


# ---- snapshots


def test_versions_are_written_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    a, b = spark.range(5), spark.createDataFrame([({"x": "1", "y": "2"},)], "m map<string,string>")
    first = store.promote("v1", {"a": a, "b": b}, source="s")
    turned = spark.createDataFrame([({"y": "2", "x": "1"},)], "m map<string,string>")
    assert store.promote("v1", {"a": a.orderBy(F.desc("id")), "b": turned}, source="s") == first
    for tables, facts in (({"a": a.limit(4), "b": b}, {"source": "s"}), ({"a": a, "b": b}, {"source": "t"}), ({"a": a}, {"source": "s"})):
        with pytest.raises(Conflict):
            store.promote("v1", tables, **facts)
    assert store.versions() == ["v1"] and store.load("v1")["a"].count() == 5 and not Folder(spark, str(tmp_path)).names("_pending")
    with pytest.raises(KeyError):
        store.load("v2")


def test_a_version_that_was_never_committed_is_not_there(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    fails = spark.range(3).withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.lit("")))
    with pytest.raises(Exception, match="stop"):
        store.promote("v1", {"a": spark.range(3), "b": fails})
    assert store.versions() == [] and store.manifest("v1") is None
    store.promote("v1", {"a": spark.range(3)})
    assert store.load("v1")["a"].count() == 3


def test_tampering_is_seen(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    store.promote("v1", {"a": spark.range(5)})
    spark.range(1).write.mode("append").parquet(str(tmp_path / "data" / "version=v1" / "a"))
    with pytest.raises(Conflict, match="differs"):
        store.load("v1")


def test_store_gate(spark, tmp_path):
    bars = canonical(derive_bars(spark, DATA))
    Store(spark, str(tmp_path / "a"), "synthetic").promote(bars, "v1")
    with pytest.raises(Conflict):
        Store(spark, str(tmp_path / "b"), "other").promote(bars, "v1")
    with pytest.raises(Conflict):
        Store(spark, str(tmp_path / "b"), "synthetic").promote(bars.withColumn("quality_status", F.lit("REJECT")), "v1")
    with pytest.raises(Conflict):
        Store(spark, str(tmp_path / "b"), "synthetic").promote(bars.where("false"), "v1")


# ---- identities

GOOD = [("i1", "A", "Alpha", "XNYS", "COMMON_STOCK", "USD", day("2000-01-01"), None, {"p": "1", "q": "x"}), ("i2", "B", "Beta", "XNAS", "ETF", "USD", None, day("2010-01-01"), {"p": "2"})]
SYMBOLS = [("i1", "A", "XNYS", day("2000-01-01"), day("2001-12-31")), ("i1", "AA", "XNYS", day("2002-01-01"), None), ("i2", "B", "XNAS", day("2000-01-01"), None)]


def changed(rows, n, **values):
    names = [f.split()[0] for f in (ms.INSTRUMENT if len(rows[0]) == 9 else ms.HISTORY).split(", ")]
    row = dict(zip(names, rows[n], strict=True)) | values
    return [*rows[:n], tuple(row[c] for c in names), *rows[n + 1 :]]


@pytest.mark.parametrize(
    "instruments, symbols, what",
    [
        ([], SYMBOLS, "needs instruments"),
        ([*GOOD, GOOD[0]], SYMBOLS, "repeated or missing"),
        (changed(GOOD, 1, provider_ids={"q": "2"}), SYMBOLS, "without an id of p"),
        (changed(GOOD, 1, provider_ids={"p": " "}), SYMBOLS, "without an id of p"),
        (changed(GOOD, 1, provider_ids={"p": "2", "q": ""}), SYMBOLS, "blank provider ids"),
        (changed(GOOD, 1, first_trade_date=day("2011-01-01")), SYMBOLS, "delisted before"),
        (changed(GOOD, 1, provider_ids={"p": "2", "q": "x"}), SYMBOLS, "several instruments"),
        (GOOD, [*SYMBOLS, ("i3", "C", "XNYS", day("2000-01-01"), None)], "unknown instruments"),
        (GOOD, changed(SYMBOLS, 0, effective_to=day("1999-01-01")), "end before"),
        (GOOD, [*SYMBOLS, SYMBOLS[0]], "repeated symbol"),
        (GOOD, changed(SYMBOLS, 0, effective_to=day("2002-01-01")), "overlapping"),
        (GOOD, changed(SYMBOLS, 0, effective_to=None), "overlapping"),
    ],
)
def test_masters_that_are_refused(spark, tmp_path, instruments, symbols, what):
    store = ms.MasterStore(spark, str(tmp_path))
    with pytest.raises(ms.IntegrityError, match=what):
        store.promote(spark.createDataFrame(instruments, ms.INSTRUMENT), spark.createDataFrame(symbols, ms.HISTORY), "v", "p")
    assert store.snapshots.versions() == []


def test_master_round_trip(spark, tmp_path):
    store = ms.MasterStore(spark, str(tmp_path))
    instruments, symbols = spark.createDataFrame(GOOD, ms.INSTRUMENT), spark.createDataFrame(SYMBOLS, ms.HISTORY)
    store.promote(instruments, symbols, "v", "p", batches=["b1"])
    got, history = store.load("v")
    assert sorted(map(str, got.collect())) == sorted(map(str, instruments.collect())) and history.count() == 3
    with pytest.raises(Conflict):
        store.promote(instruments, symbols, "v", "p", batches=["b2"])


def test_an_ambiguous_id_raises_only_where_it_is_met(spark):
    master = spark.createDataFrame([("p", "1", "i1"), ("p", "1", "i2"), ("p", "2", "i3"), ("p", "2", "i3")], "provider_id string, provider_instrument_id string, instrument_id string")
    rows = spark.createDataFrame([("p", "2"), ("p", "9")], "provider_id string, provider_instrument_id string")
    found, missing = ql.resolve(rows, master)
    assert [r.instrument_id for r in found.collect()] == ["i3"] and [r.provider_instrument_id for r in missing.collect()] == ["9"]
    with pytest.raises(Exception, match="several instruments have the id 1"):
        ql.resolve(spark.createDataFrame([("p", "1")], rows.schema), master)[0].collect()


def actions(spark, *rows):
    return spark.createDataFrame([(p, i, e, t, day(d), f) for p, i, e, t, d, f in rows], "provider_id string, provider_instrument_id string, source_event_id string, action_type string, effective_date date, source_fields map<string,string>")


def test_actions(spark):
    master = spark.createDataFrame(GOOD, ms.INSTRUMENT)
    one, bare = ("P ", "1", "e1", "split", "2001-01-01", {"r": "2"}), ("p", "2", None, "dividend", "2001-01-01", {"c": "1"})
    with pytest.raises(ms.IntegrityError, match="blank"):
        ms.normalise_actions(actions(spark, ("p", "1", " ", "split", "2001-01-01", {})), master)
    with pytest.raises(ms.IntegrityError, match="field names"):
        ms.normalise_actions(actions(spark, ("p", "1", None, "split", "2001-01-01", {" ": "x"})), master)
    records, unresolved = ms.normalise_actions(actions(spark, ("p", *one[1:]), ("p", *one[1:]), bare, ("p", "7", "e", "split", "2001-01-01", {})), master)
    got = {r.action_id: r for r in records.collect()}
    ns = uuid.UUID(ms.ACTION_NAMESPACE)
    assert set(got) == {"tca_" + uuid.uuid5(ns, "p:1:event:e1").hex, "tca_" + uuid.uuid5(ns, "p:2:dividend:2001-01-01").hex}
    assert [r.provider_instrument_id for r in unresolved.collect()] == ["7"]
    other = ms.normalise_actions(actions(spark, ("p", *one[1:]), ("p", "1", "e1", "split", "2001-01-02", {"r": "2"})), master)[0]
    with pytest.raises(Exception, match="conflicting records"):
        other.collect()
    with pytest.raises(ms.IntegrityError, match="ambiguous"):
        ms.normalise_actions(actions(spark, bare, (*bare[:5], {"c": "2"})), master)


def test_action_store_refuses(spark, tmp_path):
    row = ("a1", "i1", "split", day("2001-01-01"), "p", "e1", {"r": "2"})
    df = lambda *rows: spark.createDataFrame(rows, ms.ACTION)
    store = ms.ActionStore(spark, str(tmp_path))
    for bad in (df((" ", *row[1:])), df((*row[:4], "q", *row[5:])), df(row, row), df(row, ("a2", *row[1:]))):
        with pytest.raises(ms.IntegrityError):
            store.promote(bad, "v", "p")
    store.promote(df(row), "v", "p")
    assert store.load("v").count() == 1
    store.promote(df(row).where("false"), "none", "p")
    assert store.load("none").count() == 0


# ---- composite bars

BARE = {"provider_instrument_id": "1", "trade_date": day("2001-01-02"), "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 5.0, "split_factor": 1.0, "dividend_cash": 0.0, "adjusted_open": None, "adjusted_high": None, "adjusted_low": None, "adjusted_close": None}
BAR = "struct<provider_instrument_id:string,trade_date:date,open:double,high:double,low:double,close:double,volume:double,split_factor:double,dividend_cash:double,adjusted_open:double,adjusted_high:double,adjusted_low:double,adjusted_close:double>"


def decided(spark, *rows):
    return spark.createDataFrame([(i, day(d), s, x, None, a, b) for i, d, s, x, a, b in rows], f"instrument_id string, trade_date date, state string, decision string, note string, a {BAR}, b {BAR}")


def owners(spark):
    return spark.createDataFrame([("A", "1", "i1"), ("B", "b1", "i1"), ("A", "2", "i2")], "provider_id string, provider_instrument_id string, instrument_id string")


def test_canonicalise_keeps_sources(spark, tmp_path):
    b = BARE | {"provider_instrument_id": "b1", "trade_date": day("2001-01-03"), "close": 2.0}
    rows = decided(
        spark,
        ("i1", "2001-01-02", "BOTH_AGREE", "CORROBORATED", BARE, b),
        ("i1", "2001-01-03", "B_ONLY", "SECONDARY_ACCEPTED", None, b),
        ("i1", "2001-01-04", "BOTH_DISAGREE", "REJECTED", BARE, b),
        ("i2", "2001-01-02", "A_ONLY", "PRIMARY_ACCEPTED", BARE | {"provider_instrument_id": "9"}, None),
        ("i2", "2001-01-03", "A_ONLY", "PRIMARY_ACCEPTED", BARE | {"provider_instrument_id": "2", "split_factor": None}, None),
    )
    bars, origin = cp.canonicalise(rows, owners(spark), "c1")
    cp.prove(bars, origin)
    assert sorted((str(r.trade_date), r.close_raw, r.provider_id) for r in bars.collect()) == [("2001-01-02", 1.0, "composite"), ("2001-01-03", 2.0, "composite")]
    got = {(r.instrument_id, str(r.trade_date)): (r.included, r.source_provider_id, r.issue, r.corroborating) for r in origin.collect()}
    assert got[("i1", "2001-01-02")] == (True, "A", None, ["A", "B"]) and got[("i1", "2001-01-03")] == (True, "B", None, ["B"])
    assert got[("i1", "2001-01-04")] == (False, None, None, []) and got[("i2", "2001-01-02")][:3] == (False, "A", "UNRESOLVED_INSTRUMENT") and got[("i2", "2001-01-03")][2] == "MISSING_SPLIT_FACTOR"
    store = cp.CompositeStore(spark, str(tmp_path))
    with pytest.raises(Conflict, match="issues"):
        store.promote(bars, origin, "c1")
    clean = origin.where("issue is null")
    with pytest.raises(Conflict, match="different keys"):
        store.promote(bars.limit(1), clean, "c1")
    with pytest.raises(Conflict, match="different keys"):
        store.promote(bars, clean.where("source_provider_id = 'A' or not included"), "c1")
    with pytest.raises(Conflict, match="different keys"):
        store.promote(bars.unionByName(bars.limit(1)), clean, "c1")
    with pytest.raises(Conflict, match="not of c2"):
        store.promote(bars, clean, "c2")
    store.promote(bars, clean, "c1")
    again, _ = store.load("c1")
    assert again.count() == 2


def test_provenance_that_is_lost_fails_the_load(spark, tmp_path):
    bars, origin = cp.canonicalise(decided(spark, ("i1", "2001-01-02", "A_ONLY", "PRIMARY_ACCEPTED", BARE, None)), owners(spark), "c1")
    store = cp.CompositeStore(spark, str(tmp_path))
    store.promote(bars, origin, "c1")
    Folder(spark, str(tmp_path)).remove("data/version=c1/provenance")
    with pytest.raises(Exception):  # noqa: B017 - the folder is gone, whatever the reader calls that
        store.load("c1")


@pytest.mark.parametrize(
    "row, what",
    [
        (("i1", "2001-01-02", "A_ONLY", "GAP_REVIEW_REQUIRED", BARE, None), "not final"),
        (("i1", "2001-01-02", "A_ONLY", "SECONDARY_ACCEPTED", BARE, None), "has no bar"),
        (("i2", "2001-01-02", "A_ONLY", "PRIMARY_ACCEPTED", BARE, None), "another instrument"),
        (("i1", "2001-01-03", "A_ONLY", "PRIMARY_ACCEPTED", BARE, None), "another instrument or day"),
    ],
)
def test_decisions_that_are_refused(spark, row, what):
    with pytest.raises(Exception, match=what):
        cp.canonicalise(decided(spark, row), owners(spark), "c1")


def test_repeated_decisions_are_refused(spark):
    row = ("i1", "2001-01-02", "A_ONLY", "REJECTED", BARE, None)
    with pytest.raises(Conflict, match="several decisions"):
        cp.canonicalise(decided(spark, row, row), owners(spark), "c1")


def test_reviews(spark):
    proposals = spark.createDataFrame([("i", day("2001-01-02"), "CORROBORATED", "r1"), ("i", day("2001-01-03"), "GAP_REVIEW_REQUIRED", "r2")], "instrument_id string, trade_date date, decision string, review_id string")
    review = lambda *rows: ql.reviewed(proposals, spark.createDataFrame(rows, "review_id string, decision string, note string")).orderBy("trade_date").collect()
    assert [r.decision for r in review(("r2", "REJECTED", "why"))] == ["CORROBORATED", "REJECTED"]
    for bad, what in ((("r1", "REJECTED", "why"), "corroborated"), (("r9", "REJECTED", "why"), "unknown"), (("r2", "CORROBORATED", "why"), "without a decision"), (("r2", "REJECTED", " "), "without a decision")):
        with pytest.raises(Exception, match=what):
            review(bad)
    with pytest.raises(Exception, match="two reviews"):
        review(("r2", "REJECTED", "a"), ("r2", "REJECTED", "b"))


# ---- numbers and backfills


def test_numbers_over_the_whole_table(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 1000).alias("a"), "id")
    got = [(r.a, r.id) for r in numbered(df, "a", "id", name="place", parts=7).orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert numbered(df.where("false"), "a").count() == 0


def symbols(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_plans(spark):
    def plan(names=("c", "a", "b"), **more):
        i, rows = bf.plan(symbols(spark, *names), **({"provider": "p", "start": "2024-01-01", "end": "2024-01-10", "days": 4, "chunk": 2} | more))
        return i, [(r.sequence, r.batch_id, str(r.window_start), str(r.window_end), r.symbols) for r in rows.orderBy("sequence").collect()]

    first, rows = plan()
    assert [r[2:] for r in rows] == [(a, b, s) for a, b in (("2024-01-01", "2024-01-04"), ("2024-01-05", "2024-01-08"), ("2024-01-09", "2024-01-10")) for s in (["a", "b"], ["c"])]
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6] and plan(("b", "c", "a")) == (first, rows)
    assert plan(("a", "b"))[0] != first != plan(days=5)[0]
    for bad in ({"names": ("a", "a")}, {"names": ("a", " ")}, {"names": ()}, {"days": 0}, {"chunk": 0}, {"end": "2023-01-01"}, {"provider": " "}):
        with pytest.raises(bf.BackfillConflict):
            plan(**bad)


@pytest.fixture
def backfill(spark, tmp_path):
    plan_id, batches = bf.plan(symbols(spark, "a", "b", "c"), "p", "2024-01-01", "2024-01-10", 4, 2)
    return lambda: bf.Backfill(spark, str(tmp_path / "job"), "p", plan_id, batches)


def fetched(batches, provider="p", shift=0):
    rows = batches.select("batch_id", F.explode("symbols").alias("symbol"), F.explode(F.sequence("window_start", "window_end")).alias("trade_date"))
    return rows.withColumn("trade_date", F.date_add("trade_date", shift)).withColumn("provider_id", F.lit(provider)).withColumn("close", F.length("symbol") + F.dayofmonth("trade_date"))


def test_a_stopped_backfill_goes_on(spark, backfill, tmp_path):
    job, asked = backfill(), []

    def fetch(batches):
        ids = [r.sequence for r in batches.orderBy("sequence").collect()]
        asked.append(ids)
        if len(asked) == 3:
            raise RuntimeError("the provider is down")
        return fetched(batches)

    with pytest.raises(RuntimeError):
        job.run(fetch, step=2)
    assert job.done().count() == 4
    with pytest.raises(bf.BackfillConflict, match="not finished"):
        job.load()
    again = backfill()
    assert again.run(fetch, step=2) == 1 and asked == [[1, 2], [3, 4], [5, 6], [5, 6]]
    assert again.run(fetch, step=2) == 0 and again.load().count() == 30 and again.summary()["bars"] == 30
    again.verify(fetched)
    with pytest.raises(bf.BackfillConflict, match="other content"):
        again.verify(lambda b: fetched(b).withColumn("close", F.lit(0)))
    with pytest.raises(bf.BackfillConflict, match="another plan"):
        bf.Backfill(spark, str(tmp_path / "job"), "p", "backfill-other", again.batches)


def test_bars_outside_of_their_batch_are_refused(backfill):
    for fetch in (lambda b: fetched(b, "q"), lambda b: fetched(b, shift=1), lambda b: fetched(b).withColumn("symbol", F.lit("z")), lambda b: fetched(b).unionByName(fetched(b))):
        with pytest.raises(bf.BackfillConflict):
            backfill().run(fetch, step=2)
    assert backfill().done().count() == 0


def test_small_files_appear_whole(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    folder.write_json("a/x.json", {"ü": [1, None]})
    assert folder.read_json("a/x.json") == {"ü": [1, None]} == json.loads(Path(tmp_path / "a/x.json").read_text())
    with pytest.raises(FileExistsError):
        folder.write_json("a/x.json", {})
    assert folder.names("a")[-1] == "x.json" and folder.names("none") == []
