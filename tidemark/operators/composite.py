"""Reviewed decisions over two providers become canonical bars with a provenance row each; a proof ties the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import with_instrument
from tidemark.session import shared_path
from tidemark.sources.store import Conflict, Snapshots

KEY = ["instrument_id", "trade_date"]
#: Provider of composite bars.
COMPOSITE = "composite"
#: Final decisions and the side whose bar they select.
SELECTS = {"CORROBORATED": "a", "PRIMARY_ACCEPTED": "a", "SECONDARY_ACCEPTED": "b"}
FINAL = (*SELECTS, "REJECTED")
PRICES = ("open", "high", "low", "close")
ISSUES = ("UNRESOLVED_INSTRUMENT", "MISSING_SPLIT_FACTOR", "MISSING_DIVIDEND", "PARTIAL_ADJUSTED_PRICES")


def _fail(when: Column, text: str, value: Column) -> Column:
    return F.when(when, F.raise_error(F.concat(F.lit(f"{text}: "), F.col("instrument_id"), F.lit(" "), F.col("trade_date").cast("string")))).otherwise(value)


def canonicalise(decisions: DataFrame, master: DataFrame, version: str, provider_a: str = "A", provider_b: str = "B") -> tuple[DataFrame, DataFrame]:
    """(bars, provenance) of decisions, read off one pass.

    ``decisions`` has the key, ``state`` of the evidence, ``decision``, ``note`` and provider bars ``a`` and ``b``
    (structs with provider_instrument_id, trade_date, prices, volume, split_factor, dividend_cash and adjusted_ prices; null where a side has
    none); ``master`` maps provider ids to instruments. Provenance has a row for each decision, bars one for each
    accepted decision whose bar is complete; an incomplete one is left out with its issue. A decision that is not final, a selected
    side without a bar, a bar of another instrument or day, or a repeated key fails the job.
    """
    spark = decisions.sparkSession
    side = F.create_map(*[F.lit(x) for kv in SELECTS.items() for x in kv])[F.col("decision")]
    chosen = F.when(F.col("side") == "a", F.col("a")).when(F.col("side") == "b", F.col("b"))
    rows = decisions.withColumn("decision", _fail(~F.coalesce(F.col("decision").isin(*FINAL), F.lit(False)), "a decision is not final", F.col("decision")))
    rows = rows.withColumn("side", F.when(F.col("decision") == "REJECTED", None).otherwise(side)).withColumn("x", chosen)
    rows = rows.withColumn("side", _fail(F.col("side").isNotNull() & F.col("x").isNull(), "the selected side has no bar", F.col("side")))
    source = F.when(F.col("side") == "a", provider_a).when(F.col("side") == "b", provider_b)
    rows = rows.withColumn("provider_id", source).withColumn("provider_instrument_id", F.col("x.provider_instrument_id"))
    rows = with_instrument(rows, master, name="owner")
    present = sum((F.col(f"x.adjusted_{c}").isNotNull().cast("int") for c in PRICES), F.lit(0))
    issue = (
        F.when(F.col("side").isNull(), None)
        .when(F.col("owner").isNull(), ISSUES[0])
        .when(F.col("x.split_factor").isNull(), ISSUES[1])
        .when(F.col("x.dividend_cash").isNull(), ISSUES[2])
        .when((present > 0) & (present < 4), ISSUES[3])
    )
    rows = rows.withColumn("issue", issue)
    included = F.col("side").isNotNull() & F.col("issue").isNull()
    rows = rows.withColumn("included", _fail(included & ((F.col("owner") != F.col("instrument_id")) | (F.col("x.trade_date") != F.col("trade_date"))), "a bar is of another instrument or day", included))
    agreeing = F.when(F.col("state") == "BOTH_AGREE", F.array(F.lit(provider_a), F.lit(provider_b))).when(F.col("state") == "A_ONLY", F.array(F.lit(provider_a))).when(F.col("state") == "B_ONLY", F.array(F.lit(provider_b))).otherwise(F.array().cast("array<string>"))
    raw = [F.col(f"x.{c}").alias(f"{c}_raw") for c in (*PRICES, "volume")]
    adjusted = [F.col(f"x.adjusted_{c}").alias(f"{c}_split_adjusted") for c in PRICES]
    bar = F.struct(*raw, F.col("x.split_factor").alias("split_factor"), F.col("x.dividend_cash").alias("dividend_cash"), *adjusted)
    one_pass = rows.select(
        *KEY, "included", F.lit(COMPOSITE).alias("canonical_provider_id"), F.col("provider_id").alias("source_provider_id"), F.col("provider_instrument_id").alias("source_instrument_id"),
        "state", "decision", "note", agreeing.alias("corroborating"), "issue", F.when(F.col("included"), bar).alias("bar"),
    )
    path = shared_path(spark, "canonicalised")
    one_pass.write.parquet(path)
    done = spark.read.parquet(path)
    twice = done.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise Conflict(f"several decisions for {tuple(map(str, twice[0]))}")
    bars = done.where("included").select(*KEY, "bar.*", F.lit(COMPOSITE).alias("provider_id"), F.lit(version).alias("dataset_version"), F.lit("PASS").alias("quality_status"))
    return bars, done.drop("bar")


def key_digest(df: DataFrame) -> tuple[int, int, int, int]:
    """Order-free digest of the keys of ``df``: rows, sums of two independent hashes, and the xor of one."""
    h, g = F.xxhash64(*KEY), F.xxhash64(*reversed(KEY), F.lit("keys"))
    wide = lambda x: F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0))
    r = df.agg(F.count("*"), wide(h), wide(g), F.coalesce(F.bit_xor(h), F.lit(0))).first()
    return tuple(int(x) for x in r)


def prove(bars: DataFrame, provenance: DataFrame) -> None:
    """Raise unless bars and included provenance rows have the same keys, each once, with a source.

    Equal digests mean equal keys with equal repetitions, and keys that are single on one side are single on both; nothing is joined.
    """
    inside = provenance.where("included")
    if key_digest(bars) != key_digest(inside):
        raise Conflict("bars and included provenance rows have different keys")
    if bars.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise Conflict("a key has several bars")
    if bars.where(~F.col("provider_id").eqNullSafe(F.lit(COMPOSITE))).limit(1).count() or inside.where(~F.col("canonical_provider_id").eqNullSafe(F.lit(COMPOSITE))).limit(1).count():
        raise Conflict("a bar is not of the composite provider")
    if inside.where("source_provider_id is null or source_instrument_id is null").limit(1).count():
        raise Conflict("an included row lacks its source")


class CompositeStore:
    """Bars and provenance of a version under one manifest; neither is there, or loads, without the other."""

    def __init__(self, spark: SparkSession, path: str):
        self.snapshots = Snapshots(spark, path)

    def promote(self, bars: DataFrame, provenance: DataFrame, version: str, **facts) -> dict:
        if provenance.where("issue is not null").limit(1).count():
            raise Conflict("bars with issues block a promotion")
        if not bars.limit(1).count():
            raise Conflict("a composite needs a bar")
        if bars.where(~F.col("dataset_version").eqNullSafe(F.lit(version))).limit(1).count():
            raise Conflict(f"a bar is not of {version}")
        prove(bars, provenance)
        return self.snapshots.promote(version, {"bars": bars, "provenance": provenance}, **facts)

    def load(self, version: str) -> tuple[DataFrame, DataFrame]:
        tables = self.snapshots.load(version)
        prove(tables["bars"], tables["provenance"])
        return tables["bars"], tables["provenance"]
