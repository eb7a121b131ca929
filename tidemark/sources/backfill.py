"""Backfills in batches that can be resumed: a plan, a ledger of finished batches, and commits by rename.

A batch is a window of dates and a chunk of symbols. A run takes the batches that the ledger lacks, a bounded number
at a time, fetches their bars in one job, writes bars and ledger entries aside, and commits both by one rename.
Whatever stops a run, what is committed is whole, and the next run goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.session import shared_path
from tidemark.sources.files import Folder

BATCHES = "sequence bigint, batch_id string, window_start date, window_end date, symbols array<string>"


class BackfillConflict(ValueError):
    """A plan that is not the one under way, a batch with other content, or bars outside of their batch."""


def chunked(symbols: DataFrame, size: int) -> DataFrame:
    """(chunk, symbols) of the column ``symbol`` in order, ``size`` symbols a chunk; null, blank or repeated symbols raise."""
    odd = symbols.groupBy("symbol").agg(F.count("*").alias("n")).where("symbol is null or trim(symbol) = '' or n > 1").limit(3).collect()
    if odd:
        raise BackfillConflict(f"blank or repeated symbols: {[r.symbol for r in odd]}")
    rows = numbered(symbols.select("symbol"), "symbol").withColumn("chunk", F.floor(F.col("n") / size).cast("long"))
    return rows.groupBy("chunk").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


def plan(symbols: DataFrame, provider: str, start: str, end: str, days: int, chunk: int) -> tuple[str, DataFrame]:
    """(plan id, batches): windows of ``days`` days from ``start`` to ``end``, for each chunk of symbols, numbered window by window.

    The id depends on the settings and the set of symbols, by an order-free digest. Every chunk of a window is a row, and no
    row holds more than ``chunk`` symbols.
    """
    if end < start or days < 1 or chunk < 1 or not provider.strip():
        raise BackfillConflict("a backfill needs a provider, a span of dates and positive sizes")
    path = shared_path(symbols.sparkSession, "chunks")
    chunked(symbols, chunk).write.parquet(path)
    chunks = symbols.sparkSession.read.parquet(path)
    h = F.xxhash64("symbols")
    known = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).first()
    if not known.n:
        raise BackfillConflict("a backfill needs symbols")
    text = F.sha2(F.lit("|".join(map(str, (provider, start, end, days, chunk, known.n, known.s, known.x)))), 256)
    plan_id = "backfill-" + symbols.sparkSession.range(1).select(text.alias("t")).first().t[:24]
    starts = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {int(days)} days"))
    rows = chunks.select("chunk", "symbols", F.posexplode(starts).alias("window", "window_start"))
    rows = rows.withColumn("window_end", F.least(F.date_add("window_start", days - 1), F.lit(end).cast("date")))
    rows = rows.withColumn("sequence", F.col("window") * F.lit(known.n) + F.col("chunk") + 1)
    short = F.substring(F.sha2(F.concat_ws("|", F.lit(plan_id), F.col("sequence").cast("string"), F.col("window_start").cast("string"), F.col("window_end").cast("string"), F.concat_ws(",", "symbols")), 256), 1, 12)
    batch_id = F.concat(F.lit("batch-"), F.lpad(F.col("sequence").cast("string"), 6, "0"), F.lit("-"), short)
    return plan_id, rows.withColumn("batch_id", batch_id).select("sequence", "batch_id", "window_start", "window_end", "symbols")


Fetch = Callable[[DataFrame], DataFrame]


class Backfill:
    """A backfill under ``path``. ``fetch`` takes rows of ``BATCHES`` and gives bars with batch_id, provider_id, symbol, trade_date and more."""

    def __init__(self, spark: SparkSession, path: str, provider: str, plan_id: str, batches: DataFrame):
        self.spark, self.folder, self.provider, self.plan_id, self.batches = spark, Folder(spark, path), provider, plan_id, batches
        facts = {"plan_id": plan_id, "provider": provider}
        if self.folder.exists("plan.json"):
            if self.folder.read_json("plan.json") != facts:
                raise BackfillConflict(f"another plan than {plan_id} is under way here")
        else:
            self.folder.write_json("plan.json", facts)

    def _steps(self, kind: str) -> DataFrame | None:
        found = [self.folder.path(f"steps/{n}/{kind}") for n in self.folder.names("steps")]
        return self.spark.read.parquet(*found) if found else None

    def done(self) -> DataFrame:
        """The ledger: batch_id, the number of bars and a digest of them."""
        found = self._steps("ledger")
        return found if found is not None else self.spark.createDataFrame([], "batch_id string, n bigint, digest decimal(38,0)")

    def pending(self) -> DataFrame:
        return self.batches.join(self.done().select("batch_id"), "batch_id", "left_anti")

    def _ledger(self, batches: DataFrame, bars: DataFrame) -> DataFrame:
        h = F.xxhash64(*sorted(c for c in bars.columns if c != "batch_id")).cast("decimal(38,0)")
        got = bars.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").alias("digest"))
        return batches.select("batch_id").join(got, "batch_id", "left").select("batch_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("digest", F.lit(0)).cast("decimal(38,0)").alias("digest"))

    def _check(self, batches: DataFrame, bars: DataFrame) -> None:
        """Bars of another provider, outside of their batch or with a repeated key stop the step."""
        asked = batches.select("batch_id", "symbols", "window_start", "window_end")
        inside = F.col("provider_id").eqNullSafe(F.lit(self.provider)) & F.array_contains("symbols", F.col("symbol")) & F.col("trade_date").between(F.col("window_start"), F.col("window_end"))
        bad = bars.join(asked, "batch_id", "left").where(~F.coalesce(inside, F.lit(False))).select("batch_id", "symbol", "trade_date").limit(3).collect()
        if bad:
            raise BackfillConflict(f"bars outside of their batch: {[tuple(map(str, r)) for r in bad]}")
        twice = bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
        if twice:
            raise BackfillConflict(f"repeated bars: {[tuple(map(str, r)) for r in twice]}")

    def run(self, fetch: Fetch, step: int = 64, most: int | None = None) -> int:
        """Fetch what is pending, ``step`` batches a job, in order; at most ``most`` jobs. The number of jobs done."""
        jobs = 0
        while most is None or jobs < most:
            pending = self.folder.scratch("step")
            batches = self._next(pending, step)
            first = batches.agg(F.min("sequence").alias("s")).first().s
            if first is None:
                self.folder.remove(pending)
                break
            fetch(batches).write.parquet(self.folder.path(f"{pending}/bars"))
            bars = self.spark.read.parquet(self.folder.path(f"{pending}/bars"))
            self._check(batches, bars)
            self._ledger(batches, bars).write.parquet(self.folder.path(f"{pending}/ledger"))
            self.folder.commit(pending, f"steps/{first:012d}")
            jobs += 1
        return jobs

    def _next(self, pending: str, step: int) -> DataFrame:
        path = self.folder.path(f"{pending}/batches")
        self.pending().orderBy("sequence").limit(step).write.parquet(path)
        return self.spark.read.parquet(path)

    def verify(self, fetch: Fetch) -> None:
        """Fetch the finished batches again; content that differs from the ledger raises."""
        done = self.done()
        again = self._ledger(done, fetch(self.batches.join(done.select("batch_id"), "batch_id")))
        other = done.join(again.select("batch_id", F.col("n").alias("n2"), F.col("digest").alias("d2")), "batch_id").where("n <> n2 or digest <> d2").limit(3).collect()
        if other:
            raise BackfillConflict(f"finished batches have other content now: {[r.batch_id for r in other]}")

    def load(self) -> DataFrame:
        """The bars of a finished plan; pending batches, or a bar that two batches hold, raise."""
        open_ = self.pending().limit(1).collect()
        if open_:
            raise BackfillConflict(f"{open_[0].batch_id} is not finished")
        bars = self._steps("bars")
        twice = bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise BackfillConflict(f"two batches hold {tuple(map(str, twice[0]))}")
        return bars

    def summary(self) -> dict[str, Any]:
        got = self.done().agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("bars")).first()
        return {"plan_id": self.plan_id, "batches": got.batches, "bars": got.bars}
