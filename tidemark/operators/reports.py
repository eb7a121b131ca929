"""Readings of results: evidence states, sample accounting, nearest-rank quantiles, experiment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_state(n: Column, excess: Column, positive_fraction: Column) -> Column:
    """What the events of one instrument say: the sign of the excess and the share of gains must agree."""
    return (
        F.when(n == 0, "NO_EVENTS")
        .when(n < 10, "INSUFFICIENT_SAMPLE")
        .when((excess > 0) & (positive_fraction >= 0.5), "EXPLORATORY_POSITIVE")
        .when((excess < 0) & (positive_fraction < 0.5), "EXPLORATORY_NEGATIVE")
        .otherwise("MIXED")
    )


def edge_report(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per instrument: events (forward_return) against the baseline's mean, and the evidence state. Instruments without events are listed."""
    own = events.groupBy("instrument_id").agg(F.count("forward_return").alias("n"), F.avg("forward_return").alias("mean_return"), F.avg((F.col("forward_return") > 0).cast("double")).alias("positive_fraction"))
    usual = baseline.groupBy("instrument_id").agg(F.count("forward_return").alias("baseline_n"), F.avg("forward_return").alias("baseline_mean"))
    rows = usual.join(own, "instrument_id", "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("excess", F.col("mean_return") - F.col("baseline_mean"))
    return rows.withColumn("evidence", evidence_state(F.col("n"), F.col("excess"), F.col("positive_fraction")))


def sample_accounting(outcomes: DataFrame) -> DataFrame:
    """Per horizon: raw and complete events, instruments, months as clusters, excluded events. Counts that cannot be fail the job."""
    done = F.col("status") == "COMPLETE"
    got = outcomes.groupBy("horizon").agg(
        F.count("*").alias("raw_events"), F.count_if(done).alias("complete_events"), F.countDistinct("instrument_id").alias("instruments"),
        F.countDistinct(F.when(done, F.date_format("signal_date", "yyyy-MM"))).alias("clusters"), F.count_if(~done).alias("excluded"),
    )
    effective = F.least("clusters", "complete_events")
    sound = (F.col("instruments") <= F.col("raw_events")) & (F.col("complete_events") + F.col("excluded") == F.col("raw_events"))
    return got.withColumn("effective_size", F.when(sound, effective).otherwise(F.raise_error(F.lit("counts of a sample contradict each other")).cast("bigint")))


def nearest_rank(values: DataFrame, by: list[str], x: str, p: Sequence[float]) -> DataFrame:
    """Quantiles that are observed values: the rank rounded half to even, and the rank rounded down."""
    lists = values.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(x)).alias("all"))
    rows = lists.select(*by, "all", F.explode(F.array(*[F.lit(float(q)) for q in p])).alias("p"))
    rank = (F.size("all") - 1) * F.col("p")
    return rows.select(*by, "p", F.element_at("all", (F.bround(rank, 0) + 1).cast("int")).alias("rounded"), F.element_at("all", (F.floor(rank) + 1).cast("int")).alias("floored"))


def filter_experiments(experiments: DataFrame, state: str | None = None, programs: Sequence[str] | None = None, since: str | None = None, until: str | None = None, text: str | None = None) -> DataFrame:
    """Rows (experiment_id, title, state, program, created) that meet all given filters; both ends of the range count."""
    rows = experiments
    if state is not None:
        rows = rows.where(F.col("state") == state)
    if programs is not None:
        rows = rows.where(F.col("program").isin(list(programs)))
    if since is not None:
        rows = rows.where(F.col("created") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.where(F.col("created") <= F.lit(until).cast("date"))
    return rows if text is None else rows.where(F.lower("title").contains(text.lower()))


def facets(experiments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) of each column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return experiments.select(pairs).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def fixed_cohort(bars: DataFrame, cohort: Sequence[str]) -> DataFrame:
    """Bars of a fixed list of instruments; one without a bar, or named twice, fails."""
    if len(set(cohort)) != len(cohort):
        raise ValueError("an instrument is named twice")
    rows = bars.where(F.col("instrument_id").isin(list(cohort)))
    found = {r.instrument_id for r in rows.select("instrument_id").distinct().collect()}  # as many as the list has
    if missing := sorted(set(cohort) - found):
        raise ValueError(f"no bars of {missing}")
    return rows
