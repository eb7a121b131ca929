"""Daily bars: derivation from the order tables, canonical schema, windowed scans, companion tables.

``derive_bars`` stands in for a canonical store: integer arithmetic in cents gives every engine the same
bars. All later work is "by instrument, in date order".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Canonical bar schema (DDL).
BAR_SCHEMA = (
    "instrument_id string, trade_date date, open_raw double, high_raw double, low_raw double, close_raw double, volume_raw double, "
    "split_factor double, dividend_cash double, open_split_adjusted double, high_split_adjusted double, low_split_adjusted double, "
    "close_split_adjusted double, provider_id string, dataset_version string, quality_status string"
)
INSTRUMENTS = 8


def by_date():
    return Window.partitionBy("instrument_id").orderBy("trade_date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prices(moves: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """o/h/l/c in cents from the cumulated moves ``cum`` (``r`` the last one) and the noise ``tx``."""
    cents = lambda steps: F.round(10000 * F.exp(F.lit(0.003) * steps)).cast("bigint")
    df = moves.withColumn("cc", cents(F.col("cum"))).withColumn("oc", cents(F.col("cum") - F.col("r")))
    spread = lambda x: F.floor(x * (1 + F.col("tx") % 5) / F.lit(1000.0)).cast("bigint")
    top, bottom = F.greatest("oc", "cc"), F.least("oc", "cc")
    return df.withColumn("hc", top + spread(top)).withColumn("lc", bottom - spread(bottom))


def derive_bars(spark: SparkSession, sf_dir: str, instruments: int = INSTRUMENTS) -> DataFrame:
    """One bar per instrument and ship date, with prices in cents and in units, and a running ``signal_index``."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_discount", "l_tax", "l_quantity")
    moves = items.groupBy(
        F.concat(F.lit("I"), (F.col("l_suppkey") % instruments).cast("string")).alias("instrument_id"),
        F.to_date("l_shipdate").alias("trade_date"),
    ).agg(
        F.greatest(F.lit(-3), F.least(F.lit(3), F.sum(F.round(F.col("l_discount") * 100).cast("bigint") - 5))).alias("r"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tx"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("volume"),
    )
    w = by_date()
    df = _prices(moves.withColumn("cum", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return df.select(
        "instrument_id",
        "trade_date",
        *[(F.col(c) / F.lit(100.0)).alias(n) for c, n in (("oc", "open"), ("hc", "high"), ("lc", "low"), ("cc", "close"))],
        F.col("volume").cast("double").alias("volume"),
        "oc", "hc", "lc", "cc",
        (F.row_number().over(w) - 1).alias("signal_index"),
        F.lit(True).alias("eligibility"),
        F.lit("PASS").alias("quality_status"),
        F.lit("tpch-v1").alias("dataset_version"),
    )


#: The same bars as a DuckDB common table expression.
BARS_CTE = """moves AS (
  SELECT concat('I', CAST(l_suppkey % 8 AS VARCHAR)) AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date,
         greatest(-3, least(3, sum(CAST(round(l_discount * 100) AS BIGINT) - 5))) AS r,
         sum(CAST(round(l_tax * 100) AS BIGINT)) AS tx, sum(CAST(l_quantity AS BIGINT)) AS vol
  FROM lineitem GROUP BY ALL),
cums AS (SELECT *, sum(r) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS cum FROM moves),
cents AS (SELECT *, CAST(round(10000 * exp(CAST(0.003 AS DOUBLE) * cum)) AS BIGINT) AS cc, CAST(round(10000 * exp(CAST(0.003 AS DOUBLE) * (cum - r))) AS BIGINT) AS oc FROM cums),
bars AS MATERIALIZED (
  SELECT instrument_id, trade_date, CAST(oc AS DOUBLE) / 100 AS open,
         CAST(greatest(oc, cc) + CAST(floor(greatest(oc, cc) * (1 + tx % 5) / CAST(1000 AS DOUBLE)) AS BIGINT) AS DOUBLE) / 100 AS high,
         CAST(least(oc, cc) - CAST(floor(least(oc, cc) * (1 + tx % 5) / CAST(1000 AS DOUBLE)) AS BIGINT) AS DOUBLE) / 100 AS low,
         CAST(cc AS DOUBLE) / 100 AS close, CAST(vol AS DOUBLE) AS volume, oc, cc,
         greatest(oc, cc) + CAST(floor(greatest(oc, cc) * (1 + tx % 5) / CAST(1000 AS DOUBLE)) AS BIGINT) AS hc,
         least(oc, cc) - CAST(floor(least(oc, cc) * (1 + tx % 5) / CAST(1000 AS DOUBLE)) AS BIGINT) AS lc,
         row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) - 1 AS signal_index
  FROM cents)"""


def with_bars(body: str, *more: str) -> str:
    """DuckDB SQL with the ``bars`` table expression, and ``more`` after it, before ``body``."""
    return "WITH " + ",\n".join((BARS_CTE, *more)) + "\n" + body


def canonical(bars: DataFrame) -> DataFrame:
    """Bars in the canonical schema; here adjusted prices equal raw ones."""
    raw = [F.col(n).alias(f"{n}_raw") for n in ("open", "high", "low", "close", "volume")]
    adjusted = [F.col(n).alias(f"{n}_split_adjusted") for n in ("open", "high", "low", "close")]
    return bars.select("instrument_id", "trade_date", *raw, F.lit(1.0).alias("split_factor"), F.lit(0.0).alias("dividend_cash"), *adjusted, F.lit("synthetic").alias("provider_id"), "dataset_version", "quality_status")


def research_bars(bars: DataFrame, representation: str = "split_adjusted") -> DataFrame:
    """Prices of one representation; a null adjusted price fails the job instead of slipping through."""
    if representation not in ("raw", "split_adjusted"):
        raise ValueError(f"unknown representation {representation}")

    def price(name: str) -> Column:
        chosen = F.col(f"{name}_{representation}")
        return F.when(chosen.isNull(), F.raise_error(F.lit(f"{name} has no {representation} value")).cast("double")).otherwise(chosen).alias(name)

    return bars.select("instrument_id", "trade_date", *[price(n) for n in ("open", "high", "low", "close")], F.col("volume_raw").alias("volume"), F.lit(True).alias("eligibility"), "quality_status", "dataset_version", F.lit(representation).alias("price_representation"))


def window_scan(bars: DataFrame, instruments: Sequence[str], start: str, end: str, warmup: int) -> DataFrame:
    """Rows in [start, end] and, per instrument, the last ``warmup`` rows before ``start``.

    Both range filters and the instrument filter reach the scan; only the rows before ``start`` are ranked.
    """
    wanted = bars.where(F.col("instrument_id").isin(list(instruments)) & (F.col("trade_date") <= F.lit(end).cast("date")))
    inside = wanted.where(F.col("trade_date") >= F.lit(start).cast("date"))
    before = wanted.where(F.col("trade_date") < F.lit(start).cast("date"))
    latest = Window.partitionBy("instrument_id").orderBy(F.desc("trade_date"))
    warm = before.withColumn("age", F.row_number().over(latest)).where(F.col("age") <= warmup).drop("age")
    return inside.unionByName(warm)


def serve(bars: DataFrame, membership: DataFrame, start: str, end: str, allowed: Sequence[str] = ("PASS",)) -> DataFrame:
    """Research rows of a date range: one dataset version, no blocked quality, membership known for each row.

    ``membership`` has (instrument_id, trade_date, eligible). A row without membership, a second version
    or a blocked quality state fails the job.
    """
    blocked = ~F.col("quality_status").isin("PASS", "WARN")
    rows = bars.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    versions = rows.agg(F.countDistinct("dataset_version").alias("v"), F.count_if(blocked).alias("b")).first()
    if versions["v"] > 1:
        raise ValueError("rows of several dataset versions")
    if versions["b"]:
        raise ValueError("rows of blocked quality")
    known = membership.select("instrument_id", "trade_date", F.col("eligible").alias("member"))
    joined = rows.where(F.col("quality_status").isin(list(allowed))).join(known, ["instrument_id", "trade_date"], "left")
    member = F.when(F.col("member").isNull(), F.raise_error(F.lit("a bar has no universe membership")).cast("boolean")).otherwise(F.col("member"))
    return joined.withColumn("eligibility", member).drop("member")


def flawed(bars: DataFrame) -> DataFrame:
    """The same bars with some days in quarantine and others not eligible, so that paths meet unusable bars."""
    day = F.dayofyear("trade_date")
    return bars.withColumn("eligibility", day % 29 != 0).withColumn("quality_status", F.when(day % 31 == 0, "QUARANTINE").otherwise("PASS"))


FLAWED = """flawed AS (SELECT *, dayofyear(trade_date) % 29 <> 0 AND dayofyear(trade_date) % 31 <> 0 AS usable FROM bars)"""


def second_provider(bars: DataFrame) -> DataFrame:
    """Another provider's view: rows missing on some days of the year, other closes on some."""
    day = F.dayofyear("trade_date")
    return bars.where(day % 23 != 0).withColumn("close", F.when(day % 17 == 0, F.col("close") + 0.25).otherwise(F.col("close")))


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-for-one splits derived from every 97th order."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 97 == 0)
    return orders.select(F.concat(F.lit("I"), (F.col("o_custkey") % INSTRUMENTS).cast("string")).alias("instrument_id"), F.to_date("o_orderdate").alias("effective_date"), F.lit("split").alias("action_type"), F.lit(2.0).alias("ratio")).distinct()


ACTIONS_CTE = """actions AS (
  SELECT DISTINCT concat('I', CAST(o_custkey % 8 AS VARCHAR)) AS instrument_id, CAST(o_orderdate AS DATE) AS effective_date, 'split' AS action_type, CAST(2 AS DOUBLE) AS ratio
  FROM orders WHERE o_orderkey % 97 = 0)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument master derived from suppliers: exchange, type, first trade and delisting dates."""
    k = F.col("s_suppkey") % INSTRUMENTS
    rows = table(spark, sf_dir, "supplier").groupBy(k.alias("k")).agg(F.min("s_nationkey").alias("n"), F.min("s_name").alias("primary_symbol"))
    return rows.select(
        F.concat(F.lit("I"), F.col("k").cast("string")).alias("instrument_id"),
        "primary_symbol",
        F.when(F.col("n") % 2 == 0, "XNYS").otherwise("XNAS").alias("exchange"),
        F.when(F.col("k") % 5 == 4, "ETF").otherwise("COMMON_STOCK").alias("security_type"),
        F.lit("1995-06-01").cast("date").alias("first_trade_date"),
        F.when(F.col("k") == 3, F.lit("1997-12-31").cast("date")).alias("delisting_date"),
    )


INSTRUMENTS_CTE = """instruments AS (
  SELECT concat('I', CAST(k AS VARCHAR)) AS instrument_id, primary_symbol, CASE WHEN n % 2 = 0 THEN 'XNYS' ELSE 'XNAS' END AS exchange,
         CASE WHEN k % 5 = 4 THEN 'ETF' ELSE 'COMMON_STOCK' END AS security_type, DATE '1995-06-01' AS first_trade_date,
         CASE WHEN k = 3 THEN DATE '1997-12-31' END AS delisting_date
  FROM (SELECT s_suppkey % 8 AS k, min(s_nationkey) AS n, min(s_name) AS primary_symbol FROM supplier GROUP BY 1))"""
