"""Evidence about histories: normalisation, coverage, edges, split semantics, profiles, matches, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(rows: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, issues) of provider rows: the first rule that fails drops a row.

    ``rows`` has provider ids, prices, split_factor, dividend_cash and adjusted prices; ``master`` maps
    (provider_id, provider_instrument_id) to instrument_id.
    """
    keys = ["provider_id", "provider_instrument_id"]
    joined = rows.join(master, keys, "left")
    adjusted = [F.col(f"adjusted_{c}") for c in ("open", "high", "low", "close")]
    present = sum((c.isNotNull().cast("int") for c in adjusted), F.lit(0))
    issue = (
        F.when(F.col("instrument_id").isNull(), "UNRESOLVED_INSTRUMENT")
        .when(F.col("split_factor").isNull(), "MISSING_SPLIT_FACTOR")
        .when(F.col("dividend_cash").isNull(), "MISSING_DIVIDEND")
        .when((present > 0) & (present < 4), "PARTIAL_ADJUSTED_PRICES")
    )
    marked = joined.withColumn("issue", issue)
    return marked.where("issue is null").drop("issue"), marked.where("issue is not null").select(*keys, "trade_date", "issue")


def coverage_checks(bars: DataFrame, start: str, end: str, least: int, lag_days: int) -> DataFrame:
    """Per instrument: observations, lag of its first and last bar against a span, and whether all pass."""
    got = bars.groupBy("instrument_id").agg(F.count("*").alias("observations"), F.datediff(F.min("trade_date"), F.lit(start).cast("date")).alias("start_lag"), F.datediff(F.lit(end).cast("date"), F.max("trade_date")).alias("end_lag"))
    return got.withColumn("passed", (F.col("observations") >= least) & (F.col("start_lag") <= lag_days) & (F.col("end_lag") <= lag_days))


def edge_state(gap_in_a, gap_other, anchor, agrees):
    """Coverage-edge class from counts of gap dates seen by A, gap dates not B-only, and the anchor's evidence."""
    return F.when(gap_in_a > 0, "CHANGED").when(gap_other > 0, "INCONCLUSIVE").when(~anchor, "ANCHOR_MISSING").when(~agrees, "ANCHOR_DISAGREES").otherwise("CONFIRMED")


def split_semantics(bars: DataFrame, actions: DataFrame, near: float = 0.18, margin: float = 0.08) -> DataFrame:
    """Whether prices around each split look raw or adjusted: the log error of the close ratio decides.

    The last close before a split and the first on or after its day are last known values of two merges of bars and
    splits, in the order of days and against it; no split meets all bars of its instrument.
    """
    splits = actions.select("instrument_id", F.col("effective_date").alias("day"), "ratio", F.lit(0).alias("kind")).distinct()
    both = bars.select("instrument_id", F.col("trade_date").alias("day"), "close", F.lit(1).alias("kind")).unionByName(splits, allowMissingColumns=True)
    known = lambda *order: F.last("close", True).over(Window.partitionBy("instrument_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("before", known("day", "kind")).withColumn("after", known(F.desc("day"), F.desc("kind"))).where("kind = 0").withColumnRenamed("day", "effective_date")
    r = F.col("before") / F.col("after")
    raw_error, adjusted_error = F.abs(F.ln(r / F.col("ratio"))), F.abs(F.ln(r))
    state = F.when(r.isNull(), "INCONCLUSIVE").when((raw_error <= near) & (raw_error + margin < adjusted_error), "RAW_LIKE").when((adjusted_error <= near) & (adjusted_error + margin < raw_error), "ADJUSTED_LIKE").otherwise("INCONCLUSIVE")
    return got.select("instrument_id", "effective_date", state.alias("state"))


def terminal_alignment(bars: DataFrame, instruments: DataFrame, days: int = 10) -> DataFrame:
    """Delisted instruments: days between the last bar and the delisting, and whether they agree."""
    last = bars.groupBy("instrument_id").agg(F.max("trade_date").alias("last_date"))
    got = instruments.where("delisting_date is not null").join(last, "instrument_id", "left")
    gap = F.datediff("last_date", "delisting_date")
    return got.select("instrument_id", "delisting_date", "last_date", gap.alias("day_error"), F.coalesce(F.abs(gap) <= days, F.lit(False)).alias("aligned"))


def raw_profile(bars: DataFrame, gap_days: int = 7) -> DataFrame:
    """Per instrument: rows, missing and invalid values, calendar gaps, and its span."""
    w = Window.partitionBy("instrument_id").orderBy("trade_date", "arrival")
    gap = F.datediff("trade_date", F.lag("trade_date").over(w))
    marked = bars.withColumn("gap", gap)
    return marked.groupBy("instrument_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("gap") == 0).alias("duplicates"), F.count_if(F.col("close").isNull()).alias("missing_close"),
        F.count_if((F.col("open") < 0) | (F.col("volume") < 0)).alias("negative_values"), F.count_if(F.col("gap") > gap_days).alias("calendar_gaps"),
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
    )


def sample_gate(bars: DataFrame, instruments: DataFrame, policy: dict[str, int]) -> DataFrame:
    """One row: the counts that a representative sample needs, and the names of those that fall short."""
    one = F.lit(1).alias("one")
    counts = bars.agg(F.count("*").alias("bars"), F.countDistinct("instrument_id").alias("instruments"), F.datediff(F.max("trade_date"), F.min("trade_date")).cast("bigint").alias("days"), one)
    more = instruments.agg(F.count("delisting_date").alias("delisted"), F.countDistinct("exchange").alias("exchanges"), one)
    row = counts.join(F.broadcast(more), "one").drop("one")
    failures = F.array_compact(F.array(*[F.when(F.col(k) < v, F.lit(k)) for k, v in policy.items()]))
    return row.withColumn("failures", F.concat_ws(",", failures)).withColumn("passed", F.size(failures) == 0)


def correction_probe(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Per instrument: IDENTICAL, REVISED or NOT_COMPARABLE, from counts and order-free hashes of two snapshots."""
    h = F.xxhash64("trade_date", *columns)
    digest = lambda df, p: df.groupBy("instrument_id").agg(F.count("*").alias(f"{p}_n"), F.sum(h.cast("decimal(38,0)")).alias(f"{p}_h"))
    both = digest(before, "a").join(digest(after, "b"), "instrument_id", "full_outer")
    state = F.when(F.col("a_n").isNull() | F.col("b_n").isNull(), "NOT_COMPARABLE").when((F.col("a_n") == F.col("b_n")) & (F.col("a_h") == F.col("b_h")), "IDENTICAL").otherwise("REVISED")
    return both.select("instrument_id", state.alias("state"))


def match_reference(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """(candidate_id, state, reference_id): exact symbol and exchange, else symbol alone, else ambiguous or unmatched (-1)."""
    clean = lambda c: F.upper(F.trim(c))
    c = candidates.select("candidate_id", clean("symbol").alias("symbol"), clean("exchange").alias("exchange"))
    r = reference.select("reference_id", clean("symbol").alias("symbol"), clean("exchange").alias("ref_exchange"))
    joined = c.join(r, "symbol", "left")
    same = F.col("exchange") == F.col("ref_exchange")
    got = joined.groupBy("candidate_id").agg(F.count_if(same).alias("exact"), F.count("reference_id").alias("by_symbol"), F.min(F.when(same, F.col("reference_id"))).alias("exact_id"), F.min("reference_id").alias("any_id"))
    state = F.when(F.col("exact") == 1, "EXACT").when(F.col("exact") > 1, "AMBIGUOUS").when(F.col("by_symbol") == 1, "SYMBOL_ONLY").when(F.col("by_symbol") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    chosen = F.when(state == "EXACT", F.col("exact_id")).when(state == "SYMBOL_ONLY", F.col("any_id"))
    return got.select("candidate_id", state.alias("state"), F.coalesce(chosen, F.lit(-1)).alias("reference_id"))


def stratified(rows: DataFrame, stratum: str, identifier: str, seed: str, per_stratum: int) -> DataFrame:
    """The first ``per_stratum`` ids of each stratum in the order of a seeded digest."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(identifier).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order, identifier))
    return rows.withColumn("place", place).where(F.col("place") <= per_stratum)


def dominance(configs: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """(config, dominated_by): pairs where one is no worse on every measure and better on one. Configurations are few."""
    other = configs.select(*[F.col(c).alias(f"o_{c}") for c in configs.columns])
    pairs = configs.withColumn("one", F.lit(1)).join(other.withColumn("one", F.lit(1)), "one").where("config <> o_config")
    no_worse, better = F.lit(True), F.lit(False)
    for m, sign in [(m, 1) for m in up] + [(m, -1) for m in down]:
        a, b = F.col(f"o_{m}") * sign, F.col(m) * sign
        no_worse, better = no_worse & (a >= b), better | (a > b)
    return pairs.where(no_worse & better).select("config", F.col("o_config").alias("dominated_by"))
