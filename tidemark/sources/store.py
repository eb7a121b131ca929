"""Versioned, immutable stores over Parquet. The tables of a version and its manifest appear together, by one rename."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import Folder


class Conflict(ValueError):
    """A version exists with other content, or is not what its manifest says."""


def content_digest(df: DataFrame, columns: list[str]) -> str:
    """Order-free digest: count, and the sum and xor of row hashes. Maps count by their sorted entries."""
    kinds = dict(df.dtypes)
    h = F.xxhash64(*[F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c) for c in columns])
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).first()
    return f"{row.n}:{row.s}:{row.x}"


class Snapshots:
    """Versions under ``path``, each of some tables and facts about them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def versions(self) -> list[str]:
        return [n.removeprefix("version=") for n in self.folder.names("data")]

    def manifest(self, version: str) -> dict[str, Any] | None:
        name = f"data/version={version}/manifest.json"
        return self.folder.read_json(name) if self.folder.exists(name) else None

    def promote(self, version: str, tables: Mapping[str, DataFrame], **facts: Any) -> dict[str, Any]:
        """Write ``tables`` once as ``version``. The same content and facts again are fine, others raise.

        Digests are taken of what was written, so they and the data are one computation of the tables.
        """
        pending = self.folder.scratch(version)
        digests = {}
        for name, df in tables.items():
            df.write.parquet(self.folder.path(f"{pending}/{name}"))
            digests[name] = content_digest(self.spark.read.parquet(self.folder.path(f"{pending}/{name}")), sorted(df.columns))
        manifest = {"version": version, "digests": digests, "rows": {n: int(d.split(":")[0]) for n, d in digests.items()}, "facts": facts}
        if known := self.manifest(version):
            self.folder.remove(pending)
            if known != manifest:
                raise Conflict(f"{version} exists with other content or facts")
            return known
        self.folder.write_json(f"{pending}/manifest.json", manifest)
        try:
            self.folder.commit(pending, f"data/version={version}")
        except FileExistsError as taken:  # another writer was first
            if self.manifest(version) != manifest:
                raise Conflict(f"{version} exists with other content or facts") from taken
        return manifest

    def load(self, version: str, verify: bool = True) -> dict[str, DataFrame]:
        """The tables of a version; each must equal the manifest."""
        known = self.manifest(version)
        if known is None:
            raise KeyError(version)
        tables = {n: self.spark.read.parquet(self.folder.path(f"data/version={version}/{n}")) for n in known["digests"]}
        for name, df in tables.items():
            if verify and content_digest(df, sorted(df.columns)) != known["digests"][name]:
                raise Conflict(f"{name} of {version} differs from its manifest")
        return tables


class Store:
    """One dataset a version. With ``provider``, a version must be of that provider alone and hold no blocked quality state."""

    def __init__(self, spark: SparkSession, path: str, provider: str | None = None, allowed: tuple[str, ...] = ("PASS", "WARN")):
        self.snapshots, self.provider, self.allowed = Snapshots(spark, path), provider, allowed

    def manifest(self, version: str) -> dict[str, Any] | None:
        return self.snapshots.manifest(version)

    def _gate(self, df: DataFrame) -> None:
        blocked = ~F.coalesce(F.col("quality_status").isin(list(self.allowed)), F.lit(False))
        got = df.agg(F.count("*").alias("n"), F.count_if(blocked).alias("blocked"), F.count_if(~F.col("provider_id").eqNullSafe(F.lit(self.provider))).alias("foreign")).first()
        if not got.n or got.blocked or got.foreign:
            raise Conflict(f"{got.n} rows, {got.blocked} of blocked quality, {got.foreign} of another provider than {self.provider}")

    def promote(self, df: DataFrame, version: str) -> dict[str, Any]:
        if self.provider is not None:
            self._gate(df)
        return self.snapshots.promote(version, {"rows": df})

    def load(self, version: str, verify: bool = True) -> DataFrame:
        return self.snapshots.load(version, verify)["rows"]
