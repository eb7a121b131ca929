"""Data quality, calendars, identity, reconciliation, revisions, split factors, universes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANKS = ("PASS", "WARN", "QUARANTINE", "REJECT")


def rank_of(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in RANKS]), status) - 1


def status_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in RANKS]), (rank + 1).cast("int"))


def worst(status: Column) -> Column:
    """Aggregate: the worst of several states."""
    return status_of(F.max(rank_of(status)))


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def issues(bars: DataFrame) -> DataFrame:
    """(instrument_id, trade_date, issue, status): the daily-bar rules.

    A non-finite value ends the checks of its row; high below low leaves out the range checks.
    ``arrival`` orders rows of one key: all but the first are duplicates. Split factors and dividends are
    looked at where ``bars`` has these columns.
    """
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    first = F.row_number().over(Window.partitionBy("instrument_id", "trade_date").orderBy("arrival")) == 1
    broken = _bad(F.col("volume"))
    for p in prices:
        broken = broken | _bad(p)
    crossed = F.col("high") < F.col("low")

    def rule(name: str, status: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(status).alias("status")))

    outside = lambda c: (F.col(c) > F.col("high")) | (F.col(c) < F.col("low"))
    fine = ~broken
    rules = [
        rule("DUPLICATE", "REJECT", ~F.col("first")),
        rule("NON_FINITE", "REJECT", broken),
        rule("NEGATIVE_PRICE", "REJECT", fine & (F.least(*prices) < 0)),
        rule("NEGATIVE_VOLUME", "REJECT", fine & (F.col("volume") < 0)),
        rule("HIGH_BELOW_LOW", "REJECT", fine & crossed),
        rule("OPEN_OUTSIDE_RANGE", "QUARANTINE", fine & ~crossed & outside("open")),
        rule("CLOSE_OUTSIDE_RANGE", "QUARANTINE", fine & ~crossed & outside("close")),
    ]
    if "split_factor" in bars.columns:
        rules.append(rule("INVALID_SPLIT_FACTOR", "QUARANTINE", fine & (_bad(F.col("split_factor")) | (F.col("split_factor") <= 0))))
    if "dividend_cash" in bars.columns:
        rules.append(rule("NEGATIVE_DIVIDEND", "QUARANTINE", fine & (_bad(F.col("dividend_cash")) | (F.col("dividend_cash") < 0))))
    marked = bars.withColumn("first", first).withColumn("found", F.array_compact(F.array(*rules)))
    return marked.select("instrument_id", "trade_date", F.explode("found").alias("x")).select("instrument_id", "trade_date", "x.issue", "x.status")


def annotate(bars: DataFrame, found: DataFrame) -> DataFrame:
    """Bars with the worst state of their key."""
    state = found.groupBy("instrument_id", "trade_date").agg(worst(F.col("status")).alias("state"))
    return bars.join(state, ["instrument_id", "trade_date"], "left").withColumn("quality_status", F.coalesce("state", F.lit("PASS"))).drop("state")


def completeness(expected: DataFrame, observed: DataFrame, warn: float = 0.01, quarantine: float = 0.05) -> DataFrame:
    """Per instrument: expected, missing and unexpected sessions, and a state by strict thresholds."""
    both = expected.select("instrument_id", "trade_date", F.lit(1).alias("e")).join(observed.select("instrument_id", "trade_date", F.lit(1).alias("o")), ["instrument_id", "trade_date"], "full_outer")
    got = both.groupBy("instrument_id").agg(F.count("e").alias("expected"), F.count_if(F.col("o").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    share = F.try_divide(F.col("missing"), F.col("expected"))
    return got.withColumn("missing_fraction", share).withColumn("status", F.when(share > quarantine, "QUARANTINE").when(share > warn, "WARN").otherwise("PASS"))


def cross_section(bars: DataFrame, least: int, most: int) -> DataFrame:
    """Instruments per session against a range."""
    got = bars.groupBy("trade_date").agg(F.countDistinct("instrument_id").alias("instruments"))
    return got.withColumn("status", F.when(F.col("instruments").between(least, most), "PASS").otherwise("WARN"))


def price_jumps(bars: DataFrame, actions: DataFrame, threshold_pct: float) -> DataFrame:
    """Moves of at least the threshold between neighbouring bars without a corporate action in (previous, current].

    Actions are few per instrument; the band condition rides on an equi-join by instrument.
    """
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    moves = bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("prev_date", F.lag("trade_date").over(w))
    moves = moves.where((F.col("prev_close") > 0) & (F.round(F.abs(F.col("close") / F.col("prev_close") - 1) * 100, 8) >= threshold_pct))
    a = actions.select(F.col("instrument_id").alias("ai"), "effective_date")
    explained = (F.col("instrument_id") == F.col("ai")) & (F.col("effective_date") > F.col("prev_date")) & (F.col("effective_date") <= F.col("trade_date"))
    return moves.join(a, explained, "left_anti").select("instrument_id", "trade_date", "prev_date", "close", "prev_close")


def nearby_actions(jumps: DataFrame, actions: DataFrame, days: int) -> DataFrame:
    """Jumps with the types of actions within +- ``days``."""
    a = actions.select(F.col("instrument_id").alias("ai"), "effective_date", "action_type")
    near = (F.col("instrument_id") == F.col("ai")) & (F.abs(F.datediff("effective_date", "trade_date")) <= days)
    return jumps.join(a, near, "left").groupBy("instrument_id", "trade_date").agg(F.concat_ws(",", F.sort_array(F.collect_set("action_type"))).alias("action_types"), F.count("effective_date").alias("n_actions"))


# ---- exchange calendar; fixed values: closures beside the holidays' rules
CLOSURES = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday of a month; the last for n = -1."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> date:
    """Gregorian computus."""
    century, golden = year // 100, year % 19
    moon = (19 * golden + century - century // 4 - (8 * century + 13) // 25 + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - golden) // 11))
    sunday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    offset = moon - sunday
    month = 3 + (offset + 40) // 44
    return date(year, month, offset + 28 - 31 * (month // 4))


def holidays(year: int) -> set[date]:
    """Closed days of the exchange: fixed ones observed on the nearest weekday, n-th weekdays, Good Friday."""

    def observed(d: date) -> date:
        return d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d

    out = {_nth(year, 2, 0, 3), easter(year) - timedelta(2), _nth(year, 5, 0, -1), observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), observed(date(year, 12, 25))}
    new_year = date(year, 1, 1)
    if new_year.weekday() != 5:  # a Saturday is not made up for in the old year
        out.add(observed(new_year))
    if year >= 1998:
        out.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        out.add(observed(date(year, 6, 19)))
    return out


def sessions(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Exchange sessions of a range: weekdays without closed days."""
    closed = sorted({d for y in range(start.year, end.year + 1) for d in holidays(y)} | {date.fromisoformat(x) for x in CLOSURES})
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("trade_date")).where(F.weekday("trade_date") < 5)
    table = spark.createDataFrame([(d,) for d in closed], "trade_date date")
    return days.join(F.broadcast(table), "trade_date", "left_anti")


EXCHANGES = ("XNYS", "XNAS")


def session_completeness(bars: DataFrame, instruments: DataFrame, end: date, start: date | None = None) -> DataFrame:
    """Per instrument: the sessions that it should have between its listing and its delisting, and where its bars differ.

    ``instruments`` has (instrument_id, exchange, first_trade_date, delisting_date), dates null where unknown; ``start`` is the
    first day that the dataset claims. Expected are the sessions from the later of first trade (or first bar) and ``start`` to the
    earlier of delisting and ``end``. Missing and unexpected dates are sorted arrays, a calendar's length at most. An
    instrument without bars lacks its history, unless it should have none. Several versions, a bar outside of the claimed span or of an
    unknown instrument, a repeated instrument or another exchange raise.

    Each instrument's days come from its own row, and closed days, one row each, are all that is broadcast.
    """
    spark = bars.sparkSession
    got = bars.agg(F.count("*").alias("n"), F.count_distinct("dataset_version").alias("versions"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).first()
    if not got.n or got.versions != 1 or got.b > end or (start is not None and (got.a < start or end < start)):
        raise ValueError(f"{got.n} bars of {got.versions} versions from {got.a} to {got.b} are not what {start} to {end} claims")
    odd = instruments.groupBy("instrument_id").agg(F.count("*").alias("n"), F.max((~F.coalesce(F.col("exchange").isin(*EXCHANGES), F.lit(False))).cast("int")).alias("other")).where("n > 1 or other = 1").limit(3).collect()
    unknown = bars.join(instruments, "instrument_id", "left_anti").select("instrument_id").limit(3).collect()
    if odd or unknown:
        raise ValueError(f"repeated instruments or other exchanges: {[r.instrument_id for r in odd]}; bars of unknown instruments: {[r.instrument_id for r in unknown]}")
    seen = bars.groupBy("instrument_id").agg(F.min("trade_date").alias("observed_first"), F.max("trade_date").alias("observed_last"), F.count("*").alias("observed"), F.count_distinct("trade_date").alias("observed_dates"))
    rows = instruments.select("instrument_id", "exchange", "first_trade_date", "delisting_date").join(seen, "instrument_id", "left")
    first, last = F.coalesce("first_trade_date", "observed_first"), F.least("delisting_date", F.lit(end))
    rows = rows.withColumn("expected_start", F.when(first.isNull(), F.lit(start)).otherwise(F.greatest(first, F.lit(start)))).withColumn("expected_end", last)
    years = range((min(start, got.a) if start else got.a).year - 1, end.year + 1)
    early = instruments.agg(F.min("first_trade_date")).first()[0]
    years = range(min(years.start, early.year), years.stop) if early else years
    closed = spark.createDataFrame([(d,) for d in sorted({d for y in years for d in holidays(y)} | {date.fromisoformat(x) for x in CLOSURES})], "trade_date date")
    days = F.when(F.col("observed").isNotNull() & (F.col("expected_start") <= F.col("expected_end")), F.sequence("expected_start", "expected_end"))
    expected = rows.select("instrument_id", F.explode(days).alias("trade_date")).where(F.weekday("trade_date") < 5).join(F.broadcast(closed), "trade_date", "left_anti").select("instrument_id", "trade_date", F.lit(1).alias("e"), F.lit(0).alias("o"))
    both = expected.unionByName(bars.select("instrument_id", "trade_date", F.lit(0).alias("e"), F.lit(1).alias("o"))).groupBy("instrument_id", "trade_date").agg(F.max("e").alias("e"), F.max("o").alias("o"))
    dates = lambda when, name: F.sort_array(F.collect_list(F.when(when, F.col("trade_date")))).alias(name)
    found = both.groupBy("instrument_id").agg(F.sum("e").alias("expected"), dates((F.col("e") == 1) & (F.col("o") == 0), "missing"), dates((F.col("e") == 0) & (F.col("o") == 1), "unexpected"))
    none = F.array().cast("array<date>")
    out = rows.join(found, "instrument_id", "left").withColumn("missing", F.coalesce("missing", none)).withColumn("unexpected", F.coalesce("unexpected", none))
    out = out.withColumn("duplicates", F.coalesce(F.col("observed") - F.col("observed_dates"), F.lit(0))).withColumn("missing_history", F.col("observed").isNull() & ~F.coalesce(F.col("expected_start") > F.col("expected_end"), F.lit(False)))
    complete = ~F.col("missing_history") & (F.col("duplicates") == 0) & (F.size("missing") == 0) & (F.size("unexpected") == 0)
    return out.select("instrument_id", "exchange", "expected_start", "expected_end", "observed_first", "observed_last", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("expected", F.lit(0)).alias("expected"), "duplicates", "missing_history", "missing", "unexpected", complete.alias("complete"))


# ---- identity


def history_overlaps(history: DataFrame) -> DataFrame:
    """Distinct intervals (instrument_id, symbol, effective_from, effective_to) that begin before an earlier one of their instrument has ended.

    Ends count as inside, and an open end lasts for ever. The latest end so far is a running maximum, so an interval
    that spans several later ones is found against each.
    """
    w = Window.partitionBy("instrument_id").orderBy("effective_from", F.coalesce("effective_to", F.lit("9999-12-31").cast("date")), "symbol")
    end = F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
    rows = history.select("instrument_id", "symbol", "effective_from", "effective_to").distinct()
    rows = rows.withColumn("held_until", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where(F.col("effective_from") <= F.col("held_until")).select("instrument_id", "symbol", "effective_from", "effective_to", "held_until")


def normalised_history(history: DataFrame) -> DataFrame:
    """The distinct intervals; an overlap fails."""
    bad = history_overlaps(history).orderBy("instrument_id", "effective_from").limit(3).collect()
    if bad:
        raise ValueError(f"overlapping symbol intervals: {[(r.instrument_id, r.symbol, str(r.effective_from)) for r in bad]}")
    return history.select("instrument_id", "symbol", "effective_from", "effective_to").distinct()


def provenance_gaps(bars: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per instrument: bars without an included provenance row, and included provenance rows without a bar. ``provenance`` has (instrument_id, trade_date, included)."""
    have = bars.select("instrument_id", "trade_date", F.lit(1).alias("bar")).distinct()
    want = provenance.where("included").select("instrument_id", "trade_date", F.lit(1).alias("origin")).distinct()
    both = have.join(want, ["instrument_id", "trade_date"], "full")
    return both.groupBy("instrument_id").agg(F.count_if(F.col("origin").isNull()).alias("without_origin"), F.count_if(F.col("bar").isNull()).alias("without_bar"), F.count_if(F.col("bar").isNotNull() & F.col("origin").isNotNull()).alias("matched"))


def symbol_as_of(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows (instrument_id, trade_date) with the symbol valid on the date; two matches fail the job."""
    h = history.select(F.col("instrument_id").alias("hi"), "symbol", "effective_from", "effective_to")
    valid = (F.col("instrument_id") == F.col("hi")) & (F.col("trade_date") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("trade_date") <= F.col("effective_to")))
    got = rows.join(h, valid, "left").groupBy("instrument_id", "trade_date").agg(F.count("symbol").alias("n"), F.first("symbol").alias("symbol"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("several symbols on one date"))).otherwise(F.col("symbol"))
    return got.select("instrument_id", "trade_date", one.alias("symbol"))


def with_instrument(rows: DataFrame, master: DataFrame, how: str = "left", name: str = "instrument_id") -> DataFrame:
    """``rows`` with the instrument of their provider's id as ``name``; a row whose id several instruments have fails the job.

    Only an exact id counts. ``master``: (provider_id, provider_instrument_id, instrument_id).
    """
    keys = ["provider_id", "provider_instrument_id"]
    owners = master.groupBy(*keys).agg(F.count_distinct("instrument_id").alias("_owners"), F.min("instrument_id").alias("_owner"))
    several = F.raise_error(F.concat(F.lit("several instruments have the id "), F.col("provider_instrument_id")))
    return rows.join(owners, keys, how).withColumn(name, F.when(F.col("_owners") > 1, several).otherwise(F.col("_owner"))).drop("_owners", "_owner")


def resolve(rows: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider rows split into resolved ones (with instrument_id, see :func:`with_instrument`) and unresolved ones."""
    return with_instrument(rows, master, "inner"), rows.join(master, ["provider_id", "provider_instrument_id"], "left_anti")


def name_uuid(prefix: str, namespace: str, name: Column) -> Column:
    """Name-based (version 5) UUID of ``name``, as prefix and hex digits, from SHA-1 and two fixed nibbles."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), -1, 1)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def instrument_id(provider: Column, identifier: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """The id of a provider's identifier, as tsi_<hex>."""
    return name_uuid("tsi_", namespace, F.concat_ws(":", provider, identifier))


# ---- providers side by side


def evidence(a: DataFrame, b: DataFrame, fields: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Full outer view of two providers: BOTH_AGREE, BOTH_DISAGREE, A_ONLY or B_ONLY, and the fields that differ."""
    left = a.select("instrument_id", "trade_date", F.lit(True).alias("in_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    right = b.select("instrument_id", "trade_date", F.lit(True).alias("in_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = left.join(right, ["instrument_id", "trade_date"], "full_outer")
    differing = F.array_compact(F.array(*[F.when(F.col("in_a") & F.col("in_b") & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("in_b").isNull(), "A_ONLY").when(F.col("in_a").isNull(), "B_ONLY").when(F.size("differing") == 0, "BOTH_AGREE").otherwise("BOTH_DISAGREE")
    return both.withColumn("differing", differing).withColumn("state", state)


def is_close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def adjudicate(found: DataFrame) -> DataFrame:
    """Proposal per key: corroborated, or which review it needs."""
    proposal = F.when(F.col("state") == "BOTH_AGREE", "CORROBORATED").when(F.col("state") == "BOTH_DISAGREE", "DISCREPANCY_REVIEW_REQUIRED").otherwise("GAP_REVIEW_REQUIRED")
    text = F.concat_ws("|", "instrument_id", F.col("trade_date").cast("string"), F.lit("A"), F.lit("B"), "state", F.concat_ws(",", "differing"))
    return found.select("instrument_id", "trade_date", proposal.alias("decision"), F.substring(F.sha2(text, 256), 1, 24).alias("review_id"))


def reviewed(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposals of :func:`adjudicate` after reviews (review_id, decision, note): instrument_id, trade_date, decision, note.

    A review turns a proposal that requires one into PRIMARY_ACCEPTED, SECONDARY_ACCEPTED or REJECTED. Any other
    decision, a blank note, a second review, or a review of a corroborated or unknown proposal fails the job; proposals without
    a review stay as they are.
    """
    odd = ~F.coalesce(F.col("r_decision").isin("PRIMARY_ACCEPTED", "SECONDARY_ACCEPTED", "REJECTED") & (F.trim("r_note") != ""), F.lit(False))
    once = reviews.groupBy("review_id").agg(F.count("*").alias("r_n"), F.min("decision").alias("r_decision"), F.min("note").alias("r_note"))
    both = proposals.join(once, "review_id", "full_outer")
    given = F.col("r_n").isNotNull()
    wrong = F.when(given & F.col("decision").isNull(), "a review of an unknown proposal").when(given & (F.col("r_n") > 1), "two reviews of a proposal").when(given & (F.col("decision") == "CORROBORATED"), "a review of a corroborated observation").when(given & odd, "a review without a decision or a note")
    decision = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(" "), F.col("review_id")))).otherwise(F.coalesce("r_decision", "decision"))
    return both.select("instrument_id", "trade_date", decision.alias("decision"), F.col("r_note").alias("note"))


def merge_revision(base: DataFrame, incoming: DataFrame, window_start: str, version: str, fields: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """A new version: incoming rows override, others are carried forward; each row says added, revised, unchanged or carried.

    An incoming row before the correction window fails the job.
    """
    early = F.col("trade_date") < F.lit(window_start).cast("date")
    if incoming.where(early).limit(1).count():
        raise ValueError("a correction before its window")
    keys = ["instrument_id", "trade_date"]
    old = base.select(*keys, F.struct(*fields).alias("old"))
    new = incoming.select(*keys, F.struct(*fields).alias("new"))
    joined = old.join(new, keys, "full_outer")
    change = F.when(F.col("new").isNull(), "CARRIED").when(F.col("old").isNull(), "ADDED").when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("REVISED")
    return joined.select(*keys, F.coalesce("new", "old").alias("x"), change.alias("change")).select(*keys, "x.*", "change", F.lit(version).alias("dataset_version"))


def compose(parts: Sequence[DataFrame], version: str) -> DataFrame:
    """Union of disjoint datasets under a new version; a shared key fails the job."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = F.count(F.lit(1)).over(Window.partitionBy("instrument_id", "trade_date"))
    checked = out.withColumn("n", n)
    guard = F.when(F.col("n") > 1, F.raise_error(F.lit("datasets overlap"))).otherwise(F.lit(version))
    return checked.withColumn("dataset_version", guard).drop("n")


def split_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Cumulative split factor of each bar: the product of 1/ratio over splits *after* its date; and its base-2 logarithm, ``split_log2``.

    From the last day backwards a split's running product holds for the bars before it, up to the next split: a merge of bars
    and splits in that order and the last known product, linear in both whatever the number of splits. A thousand splits leave the range of
    doubles: the logarithm is a sum and stays exact there, and a product that has left the range on its way is taken from it.
    """
    key, back = "instrument_id", lambda *c: Window.partitionBy("instrument_id").orderBy(*c).rowsBetween(Window.unboundedPreceding, 0)
    days = actions.where(F.col("action_type") == "split").groupBy(key, F.col("effective_date").alias("_day")).agg(F.product(1 / F.col("ratio")).alias("_own"), F.sum(-F.log2("ratio")).alias("_bits"))
    w = back(F.desc("_day"))
    sums = days.select(key, "_day", F.product("_own").over(w).alias("_product"), F.sum("_bits").over(w).alias("_sum"))
    left = F.max(F.abs("_sum")).over(w) > 1020
    later = F.struct(F.when(left, F.pow(F.lit(2.0), F.col("_sum"))).otherwise(F.col("_product")).alias("factor"), F.col("_sum").alias("bits"))
    splits = sums.select(key, "_day", F.lit(0).alias("_kind"), later.alias("_later"))
    both = bars.withColumn("_day", F.col("trade_date")).withColumn("_kind", F.lit(1)).unionByName(splits, allowMissingColumns=True)
    # of one day the bar comes first, as a split on its own day does not count
    both = both.withColumn("_later", F.last("_later", True).over(back(F.desc("_day"), F.desc("_kind"))))
    known = lambda field, default: F.coalesce(F.col(f"_later.{field}"), F.lit(default))
    return both.withColumn("split_factor", known("factor", 1.0)).withColumn("split_log2", known("bits", 0.0)).where("_kind = 1").drop("_day", "_kind", "_later")


def adjusted(bars: DataFrame, actions: DataFrame, dividends: DataFrame) -> DataFrame:
    """Bars with split_factor, dividend_cash (those of a day added up, 0 without one) and adjusted prices. ``dividends``: (instrument_id, effective_date, cash)."""
    bad = F.when(F.col("cash") < 0, F.raise_error(F.lit("a dividend is negative")).cast("double")).otherwise(F.col("cash"))
    paid = dividends.groupBy("instrument_id", F.col("effective_date").alias("trade_date")).agg(F.sum(bad).alias("dividend_cash"))
    rows = split_factors(bars, actions).join(paid, ["instrument_id", "trade_date"], "left").withColumn("dividend_cash", F.coalesce("dividend_cash", F.lit(0.0)))
    return rows.select("*", *[(F.col(c) * F.col("split_factor")).alias(f"adjusted_{c}") for c in ("open", "high", "low", "close")])


# ---- universe


def universe(bars: DataFrame, instruments: DataFrame, as_of: DataFrame, n: int, least_price: float, least_dollars: float, least_history: int) -> DataFrame:
    """Membership of every instrument in every session of ``as_of`` (trade_date), with ordered exclusion reasons.

    Trailing measures are windows over bars; the latest bar up to a session is the last known value in the
    order of days over bars and sessions together, so the grid of sessions and instruments is joined to nothing.
    """
    w = Window.partitionBy("instrument_id").orderBy("trade_date")
    frame = w.rowsBetween(1 - n, 0)
    dollars = F.col("close") * F.col("volume")
    measured = bars.select(
        "instrument_id", "trade_date", F.col("close").alias("price"), "quality_status",
        F.when(F.count(dollars).over(frame) == n, F.avg(dollars).over(frame)).alias("liquidity"), F.row_number().over(w).alias("history"),
    )
    # sessions are a calendar's length at most
    grid = instruments.withColumn("one", F.lit(1)).join(F.broadcast(as_of.select("trade_date", F.lit(1).alias("one"))), "one").drop("one")
    about = F.struct(*[c for c in instruments.columns if c != "instrument_id"]).alias("about")
    asked = grid.select("instrument_id", "trade_date", about, F.lit(1).alias("kind"))
    facts = measured.select("instrument_id", "trade_date", F.struct("price", "quality_status", "liquidity", "history").alias("known"), F.lit(0).alias("kind"))
    upto = Window.partitionBy("instrument_id").orderBy("trade_date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    points = asked.unionByName(facts, allowMissingColumns=True).withColumn("known", F.last("known", True).over(upto)).where("kind = 1")
    k = F.col("known")
    rows = points.select("instrument_id", "trade_date", "about.*", k["price"].alias("price"), F.coalesce(k["quality_status"], F.lit("REJECT")).alias("quality"), k["liquidity"].alias("liquidity"), F.coalesce(k["history"], F.lit(0)).alias("history"))
    d = F.col("trade_date")
    reasons = F.array_compact(F.array(
        F.when(d < F.col("first_trade_date"), "BEFORE_FIRST_TRADE"),
        F.when(d > F.col("delisting_date"), "AFTER_DELISTING"),
        F.when(~F.col("exchange").isin("XNYS", "XNAS"), "EXCHANGE"),
        F.when(F.col("security_type") != "COMMON_STOCK", "SECURITY_TYPE"),
        F.when(F.col("quality") != "PASS", "QUALITY"),
        F.when(F.col("price").isNull(), "PRICE_MISSING").when(F.col("price") < least_price, "PRICE_BELOW_MINIMUM"),
        F.when(F.col("liquidity").isNull(), "LIQUIDITY_MISSING").when(F.round("liquidity", 6) < least_dollars, "LIQUIDITY_BELOW_MINIMUM"),
        F.when(F.col("history") < least_history, "HISTORY_INSUFFICIENT"),
    ))
    return rows.select("instrument_id", "trade_date", "price", "liquidity", "history", F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("eligible"))
