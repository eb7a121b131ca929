"""Canonical bars that grow and are corrected: each revision rewrites only the months that it changes.

A table is a list of immutable month folders. A revision writes new folders for the months with added or revised
rows, and a manifest that names the folder of every month; the manifest appears by one rename, so a reader sees a
revision as a whole or not at all. A manifest carries the number of the last batch: a batch that is sent again, say by
a stream after a failure, is passed over.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bars import BAR_SCHEMA
from tidemark.sources.files import Folder

KEY = ["instrument_id", "trade_date"]
#: What makes two rows of a key the same observation, besides the key; the dataset version is no part of it.
CONTENT = (
    "open_raw", "high_raw", "low_raw", "close_raw", "volume_raw", "split_factor", "dividend_cash", "open_split_adjusted", "high_split_adjusted",
    "low_split_adjusted", "close_split_adjusted", "provider_id", "quality_status",
)
CHANGES = ("ADDED", "REVISED", "UNCHANGED")


class RevisionConflict(ValueError):
    """A revision that is ambiguous or outside of its window."""


def same_content(a: str, b: str) -> Column:
    """Whether two rows agree in all of ``CONTENT``; null equals null."""
    out = F.lit(True)
    for c in CONTENT:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def month(c: str = "trade_date") -> Column:
    return F.date_format(c, "yyyy-MM")


def classified(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys of both sides with ``old`` and ``new`` rows and ``change``: ADDED, REVISED, UNCHANGED, or null where nothing came in."""
    row = lambda name: F.struct(*CONTENT).alias(name)
    both = base.select(*KEY, row("old")).join(incoming.select(*KEY, row("new")), KEY, "full_outer")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), None).when(same_content("old", "new"), "UNCHANGED").otherwise("REVISED")
    return both.withColumn("change", change)


def checked(bars: DataFrame, what: str) -> dict[str, Any]:
    """Facts about ``bars``; several versions or providers, or a repeated key, raise."""
    keys = bars.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("provider_id").alias("p0"), F.max("provider_id").alias("p1"), F.min("dataset_version").alias("v0"), F.max("dataset_version").alias("v1"), F.count_if(F.col("provider_id").isNull() | F.col("dataset_version").isNull()).alias("unknown"))
    got = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.min("p0").alias("provider"), F.max("p1").alias("last_provider"),
        F.min("v0").alias("version"), F.max("v1").alias("last_version"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"),
        F.min("trade_date").alias("first"), F.count_if(F.col("trade_date").isNull() | F.col("instrument_id").isNull()).alias("unkeyed"),
    ).first()
    if got.repeated:
        raise RevisionConflict(f"{what} bars repeat {got.repeated} keys")
    if got.unknown or got.unkeyed:
        raise RevisionConflict(f"{what} bars lack a key, a provider or a version")
    if got.provider != got.last_provider:
        raise RevisionConflict(f"{what} bars have several providers")
    if got.version != got.last_version:
        raise RevisionConflict(f"{what} bars have several dataset versions")
    return got.asDict()


class RevisionTable:
    """Bars under ``path`` with all their revisions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def manifest(self, number: int | None = None) -> dict[str, Any] | None:
        """The manifest of a revision, or the latest."""
        names = self.folder.names("manifests")
        if number is not None:
            return self.folder.read_json(f"manifests/{number:012d}.json")
        return self.folder.read_json(f"manifests/{names[-1]}") if names else None

    def _read(self, months: dict[str, str]) -> DataFrame:
        if not months:
            return self.spark.createDataFrame([], BAR_SCHEMA)
        return self.spark.read.schema(BAR_SCHEMA).parquet(*[self.folder.path(f) for f in months.values()])

    def _write(self, rows: DataFrame, version: str) -> dict[str, str]:
        """Write ``rows`` by month, each month one folder of its own; (month: folder)."""
        place = f"data/{uuid.uuid4().hex}"
        names = [f.split()[0] for f in BAR_SCHEMA.split(", ")]
        out = rows.withColumn("dataset_version", F.lit(version)).select(*names, month().alias("month"))
        out.repartition("month").sortWithinPartitions("month", *KEY).write.partitionBy("month").parquet(self.folder.path(place))
        return {n.split("=")[1]: f"{place}/{n}" for n in self.folder.names(place) if n.startswith("month=")}

    def create(self, base: DataFrame) -> dict[str, Any]:
        """The first revision, number 0."""
        facts = checked(base, "base")
        if not facts["rows"]:
            raise RevisionConflict("a revision needs an existing dataset")
        months = self._write(base, facts["version"])
        manifest = {"number": 0, "batch": None, "version": facts["version"], "parent": None, "provider": facts["provider"], "months": months, "rows": facts["rows"], "counts": {}}
        self.folder.write_json(f"manifests/{0:012d}.json", manifest)
        return manifest

    def revise(self, incoming: DataFrame, version: str, window_start: str, batch: int | None = None) -> dict[str, Any]:
        """A new revision, or the latest one if ``batch`` was applied before; numbers of batches rise, so it was if it is not above the last.

        ``incoming`` must be of one provider, that of the table, of the version ``version``, with unique keys, and no
        row before ``window_start``. Only the months of incoming rows are read, and only those with added or
        revised rows are written.
        """
        old = self.manifest()
        if old is None:
            raise RevisionConflict("a revision needs an existing dataset")
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return old
        if version == old["version"]:
            raise RevisionConflict("a revision needs a version of its own")
        facts = checked(incoming, "incoming")
        if facts["rows"]:
            if facts["version"] != version:
                raise RevisionConflict(f"incoming bars are of {facts['version']} and not of {version}")
            if facts["provider"] != old["provider"]:
                raise RevisionConflict(f"incoming bars are of {facts['provider']} and not of {old['provider']}")
            if str(facts["first"]) < window_start:
                raise RevisionConflict(f"a correction of {facts['first']} before {window_start}")
        # a month is a row at most, whatever the number of bars
        touched = {r.month for r in incoming.select(month().alias("month")).distinct().collect()}
        there = {m: f for m, f in old["months"].items() if m in touched}
        found = classified(self._read(there), incoming).withColumn("month", month())
        per_month = found.groupBy("month", "change").agg(F.count("*").alias("n")).collect()
        counts = {c: sum(r.n for r in per_month if r.change == c) for c in CHANGES}
        changed = {r.month for r in per_month if r.change in ("ADDED", "REVISED")}
        written = {}
        if changed:
            row = F.when(F.col("change").isin("ADDED", "REVISED"), F.col("new")).otherwise(F.col("old"))
            written = self._write(found.where(F.col("month").isin(sorted(changed))).select(*KEY, row.alias("x")).select(*KEY, "x.*"), version)
        manifest = {
            "number": old["number"] + 1, "batch": old["batch"] if batch is None else batch, "version": version if changed else old["version"], "parent": old["version"], "provider": old["provider"],
            "months": old["months"] | written, "rows": old["rows"] + counts["ADDED"], "counts": counts | {"CARRIED": old["rows"] - counts["REVISED"], "MONTHS": len(changed)},
        }
        self.folder.write_json(f"manifests/{manifest['number']:012d}.json", manifest)
        return manifest

    def history(self) -> list[dict[str, Any]]:
        return [self.folder.read_json(f"manifests/{n}") for n in self.folder.names("manifests")]

    def read(self, number: int | None = None) -> DataFrame:
        """The bars of a revision, all under its version."""
        found = self.manifest(number)
        if found is None:
            raise RevisionConflict("there is no dataset yet")
        return self._read(found["months"]).withColumn("dataset_version", F.lit(found["version"]))


def revise_from_stream(table: RevisionTable, corrections: DataFrame, window_start: str, checkpoint: str, name: str = "revision") -> None:
    """Apply all corrections that a stream holds; each micro-batch is one revision, applied once."""

    def apply(batch: DataFrame, number: int) -> None:
        version = f"{name}-{number}"
        batch.persist()
        table.revise(batch.withColumn("dataset_version", F.lit(version)), version, window_start, number)
        batch.unpersist()

    corrections.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
