"""Queries of data that arrives in parts: features from stored state, corrections as a stream, resumed backfills."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.plans import features as ft
from tidemark.session import shared_path
from tidemark.sources import revisions as rv
from tidemark.sources.bars import canonical, derive_bars, with_bars
from tidemark.streaming.features import feature_stream
from tidemark.streaming.incremental import run_to_end

#: Days that cut the bars into parts: one part has few bars, one starts within the warm-up of most instruments.
CUTS = ["1995-02-01", "1997-01-01", "1997-01-09", "1999-01-01"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _digits(feature: str) -> int:
    return 8 if feature in ft.INITIAL else 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*ft.KEYS, *[F.round(f, _digits(f)).alias(f) for f in inc.FEATURES])


def feat_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features batch by batch, each from the state that the one before left; every batch is sent twice."""
    log = inc.FeatureLog(spark, shared_path(spark, "feature-log"))
    bars = derive_bars(spark, sf_dir)
    for n, part in enumerate(inc.parts(bars, CUTS)):
        log.append(part, n)
        log.append(part, n)
    return _rounded(log.features())


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream with typed state."""
    path = shared_path(spark, "bars-by-part")
    for part in inc.parts(derive_bars(spark, sf_dir), CUTS):
        part.select("instrument_id", *inc.BAR).repartition(1, "instrument_id").write.mode("append").parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        return _rounded(run_to_end(feature_stream(rows), "features", "append"))


FEATURES_SQL = (
    "SELECT instrument_id, trade_date, "
    + ", ".join(inc.FEATURES)
    + " FROM "
    + " JOIN ".join(f"({sql}) AS {n}" + (" USING (instrument_id, trade_date)" if n != "a" else "") for n, sql in zip("abcd", (ft.QUERIES["feat_initial"][1], ft.RSI_SQL, ft.MACD_SQL, ft.ATR_WILDER_SQL), strict=True))
)


# ---- corrections

BASE_END, WINDOW = "1997-01-01", "1996-06-01"


def _corrected(bars: DataFrame) -> DataFrame:
    """Bars as the corrections have them: other closes on some days, a volume that was missing on others."""
    day = F.dayofyear("trade_date")
    return bars.withColumn("close", F.when(day % 11 == 0, F.col("close") + 0.5).otherwise(F.col("close"))).withColumn("volume", F.when(day % 13 == 0, None).otherwise(F.col("volume")))


def _revised(spark: SparkSession, sf_dir: str) -> rv.RevisionTable:
    """Bars up to a day, then three micro-batches: corrected bars, the same bars again, and new bars."""
    bars = derive_bars(spark, sf_dir)
    table = rv.RevisionTable(spark, shared_path(spark, "revisions"))
    table.create(canonical(bars.where(F.col("trade_date") < F.lit(BASE_END).cast("date"))))
    path = shared_path(spark, "corrections")
    between = F.col("trade_date").between(F.lit(WINDOW).cast("date"), F.date_sub(F.lit(BASE_END).cast("date"), 1))
    for part in (_corrected(bars).where(between), _corrected(bars).where(between), bars.where(F.col("trade_date") >= F.lit(BASE_END).cast("date"))):
        canonical(part).repartition(1, "instrument_id").write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    rv.revise_from_stream(table, stream, WINDOW, shared_path(spark, "revisions-checkpoint"))
    return table


def revision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars after all revisions."""
    return _revised(spark, sf_dir).read().select("instrument_id", "trade_date", F.round("open_raw", 2).alias("open_raw"), F.round("close_raw", 2).alias("close_raw"), "volume_raw", "dataset_version")


def revision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a revision: what was added, revised, sent unchanged and carried forward, and the months written."""
    names = ("ADDED", "REVISED", "UNCHANGED", "CARRIED", "MONTHS")
    rows = [(m["number"], m["version"], m["rows"], *[m["counts"][c] for c in names]) for m in _revised(spark, sf_dir).history() if m["counts"]]
    return spark.createDataFrame(rows, "number int, dataset_version string, n_rows bigint, " + ", ".join(f"{c.lower()} bigint" for c in names))


_IN_WINDOW = f"trade_date >= DATE '{WINDOW}' AND trade_date < DATE '{BASE_END}'"
REVISION_STREAM_SQL = with_bars(
    f"""SELECT instrument_id, trade_date, open AS open_raw, CASE WHEN {_IN_WINDOW} AND dayofyear(trade_date) % 11 = 0 THEN round(close + 0.5, 2) ELSE close END AS close_raw,
       CASE WHEN {_IN_WINDOW} AND dayofyear(trade_date) % 13 = 0 THEN NULL ELSE volume END AS volume_raw, 'revision-2' AS dataset_version FROM bars"""
)
REVISION_SUMMARY_SQL = with_bars(
    f"""SELECT * FROM (
  SELECT 1 AS number, 'revision-0' AS dataset_version, base AS n_rows, 0 AS added, touched AS revised, sent - touched AS unchanged, base - touched AS carried, months FROM facts
  UNION ALL SELECT 2, 'revision-0', base, 0, 0, sent, base, 0 FROM facts
  UNION ALL SELECT 3, 'revision-2', base + fresh, fresh, 0, 0, base, fresh_months FROM facts)""",
    f"""facts AS (
  SELECT count(*) FILTER (trade_date < DATE '{BASE_END}') AS base, count(*) FILTER ({_IN_WINDOW}) AS sent, count(*) FILTER (trade_date >= DATE '{BASE_END}') AS fresh,
         count(*) FILTER ({_IN_WINDOW} AND (dayofyear(trade_date) % 11 = 0 OR dayofyear(trade_date) % 13 = 0)) AS touched,
         count(DISTINCT CASE WHEN {_IN_WINDOW} AND (dayofyear(trade_date) % 11 = 0 OR dayofyear(trade_date) % 13 = 0) THEN strftime(trade_date, '%Y-%m') END) AS months,
         count(DISTINCT CASE WHEN trade_date >= DATE '{BASE_END}' THEN strftime(trade_date, '%Y-%m') END) AS fresh_months FROM bars)""",
)


QUERIES = {
    "feat_incremental": (feat_incremental, FEATURES_SQL),
    "stream_features": (stream_features, FEATURES_SQL),
    "revision_stream": (revision_stream, REVISION_STREAM_SQL),
    "revision_summary": (revision_summary, REVISION_SUMMARY_SQL),
}
