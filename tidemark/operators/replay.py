"""What a scan would have shown on past sessions, for many dates at once.

States of the tracker are compressed to the intervals in which they hold. A replay takes requests (as_of, instrument)
and finds, for each, the last bar and the last interval up to its date by one merge in the order of days. Nothing is run
again for a date, so a replay costs its requests and the changes of state, not dates times histories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.patterns import STATES, Lifecycle

# What a replay says of an instrument on a date, in the order of its rules.
MISSING_HISTORY, DATASET_MISMATCH, MISSING_SESSION, QUALITY, MISSING_SYMBOL, EVALUATED = (
    "BLOCKED_MISSING_HISTORY", "BLOCKED_DATASET_MISMATCH", "BLOCKED_MISSING_AS_OF_SESSION", "BLOCKED_QUALITY", "BLOCKED_MISSING_SYMBOL", "EVALUATED",
)
PAYLOAD = ("state", "reason", "event", "resistance", "support", "began")


def change_intervals(states: DataFrame) -> DataFrame:
    """(instrument_id, from_date, to_date, state, reason, event, resistance, support, began): runs of equal states; ``to_date`` is the day on which the next begins, null for the last.

    Gaps and islands over the tracker's rows: an event, which lasts a bar, is an interval of its own.
    """
    order = Window.partitionBy("instrument_id").orderBy("trade_date")
    row = F.struct(*PAYLOAD)
    before = F.lag(row).over(order)
    starts = states.withColumn("_same", before.isNotNull() & before.eqNullSafe(row)).where("not _same")
    return starts.select("instrument_id", F.col("trade_date").alias("from_date"), F.lead("trade_date").over(order).alias("to_date"), *PAYLOAD)


def replay(bars: DataFrame, intervals: DataFrame, requests: DataFrame, symbols: DataFrame, dataset_version: str, universe_version: str, strategy: str = "consolidation-breakout", settings: Lifecycle | None = None) -> DataFrame:
    """One row for each request (as_of, instrument_id): status, latest_date, symbol, and the state where it is evaluated.

    ``intervals`` are those of :func:`change_intervals`, ``symbols`` (instrument_id, symbol, effective_from, effective_to). The first rule
    that holds gives the status: no bar up to the date; a last bar of another dataset version; a last bar before the date; one that is not
    eligible or not PASS; no symbol on the date. An instrument without a base is evaluated without a candidate. A request that comes
    twice fails the job.
    """
    if not universe_version.strip():
        raise ValueError("a replay needs a universe version")
    s = settings or Lifecycle()
    key = "instrument_id"
    asked = requests.groupBy("as_of", key).agg(F.count("*").alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("a request comes twice")).cast("date")).otherwise(F.col("as_of"))
    asked = asked.select(key, once.alias("_day"), F.lit(3).alias("_kind"))
    facts = F.struct("trade_date", "dataset_version", (F.col("eligibility") & (F.col("quality_status") == "PASS")).alias("ok"), "cc").alias("_bar")
    points = bars.select(key, F.col("trade_date").alias("_day"), F.lit(0).alias("_kind"), facts)
    points = points.unionByName(intervals.select(key, F.col("from_date").alias("_day"), F.lit(1).alias("_kind"), F.struct(*PAYLOAD).alias("_state")), allowMissingColumns=True)
    points = points.unionByName(symbols.select(key, F.col("effective_from").alias("_day"), F.lit(2).alias("_kind"), F.struct("symbol", "effective_to").alias("_symbol")), allowMissingColumns=True)
    points = points.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, True).over(upto).alias(c)
    rows = points.select(key, "_day", "_kind", last("_bar"), last("_state"), last("_symbol")).where("_kind = 3")
    symbol = F.when(F.col("_symbol.effective_to").isNull() | (F.col("_day") <= F.col("_symbol.effective_to")), F.col("_symbol.symbol"))
    status = (
        F.when(F.col("_bar").isNull(), MISSING_HISTORY)
        .when(~F.col("_bar.dataset_version").eqNullSafe(F.lit(dataset_version)), DATASET_MISMATCH)
        .when(F.col("_bar.trade_date") != F.col("_day"), MISSING_SESSION)
        .when(~F.coalesce(F.col("_bar.ok"), F.lit(False)), QUALITY)
        .when(symbol.isNull() | (F.trim(symbol) == ""), MISSING_SYMBOL)
        .otherwise(EVALUATED)
    )
    rows = rows.select(F.col("_day").alias("as_of"), key, status.alias("status"), F.col("_bar.trade_date").alias("latest_date"), symbol.alias("symbol"), F.col("_bar.cc").alias("cc"), "_state.*")
    seen = F.col("status") == EVALUATED
    found = seen & (F.col("state") != "NONE")
    only = lambda c: F.when(found, F.col(c)).alias(c)
    run = F.concat(F.lit("replay-"), F.substring(F.sha2(F.concat_ws("|", F.lit(strategy), F.lit(repr(s)), F.lit(dataset_version), F.lit(universe_version), F.col("as_of").cast("string")), 256), 1, 24))
    out = rows.select(run.alias("run_id"), "as_of", key, "status", "latest_date", "symbol", *[only(c) for c in PAYLOAD], F.when(found, F.col("cc")).alias("cc"))
    candidate = F.sha2(F.concat_ws("|", "run_id", key, "state", "reason", F.col("resistance").cast("string")), 256)
    return out.withColumn("candidate_id", F.when(found, F.concat(F.lit("candidate-"), F.substring(candidate, 1, 24))))


def checksum() -> Column:
    """An order-free digest of the rows of a run, for an aggregate: their number, and the sum and the xor of their hashes."""
    h = F.xxhash64("run_id", "as_of", "instrument_id", "status", F.coalesce(F.col("latest_date").cast("string"), F.lit("")), F.coalesce("symbol", F.lit("")), F.coalesce("candidate_id", F.lit("")))
    return F.concat_ws(":", F.count("*"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h))


def replay_summary(found: DataFrame) -> DataFrame:
    """Per date: requests, those evaluated and blocked, candidates by state, and the checksum of the run."""
    counts = [F.count_if(F.col("state") == x).alias(x.lower()) for x in STATES if x != "NONE"]
    return found.groupBy("run_id", "as_of").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == EVALUATED).alias("evaluated"), F.count_if(F.col("status") != EVALUATED).alias("blocked"), *counts, checksum().alias("output_checksum"))
