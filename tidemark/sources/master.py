"""Stores of identities and corporate actions: two tables of intervals under one manifest, and canonical actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import history_overlaps, name_uuid, with_instrument
from tidemark.sources.store import Snapshots

#: Namespace of the ids of corporate actions (a fixed value).
ACTION_NAMESPACE = "315de11cfd8b5f55918342a117c62d67"
INSTRUMENT = "instrument_id string, primary_symbol string, name string, exchange string, security_type string, currency string, first_trade_date date, delisting_date date, provider_ids map<string,string>"
HISTORY = "instrument_id string, symbol string, exchange string, effective_from date, effective_to date"
ACTION = "action_id string, instrument_id string, action_type string, effective_date date, provider_id string, source_event_id string, source_fields map<string,string>"


class IntegrityError(ValueError):
    """A snapshot that is not consistent in itself."""


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def _refuse(bad: DataFrame, what: str) -> None:
    """Raise if there is a row, with some of them in the message."""
    rows = bad.limit(3).collect()
    if rows:
        raise IntegrityError(f"{what}: {[tuple(map(str, r)) for r in rows]}")


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def check_master(instruments: DataFrame, history: DataFrame, provider: str) -> None:
    """Raise unless ids are unique, every instrument has an id of ``provider``, no provider's id has two owners, and symbol intervals are known, ordered and disjoint."""
    if not instruments.limit(1).count():
        raise IntegrityError("a snapshot needs instruments")
    dates = F.col("delisting_date") < F.col("first_trade_date")
    found = instruments.groupBy("instrument_id").agg(F.count("*").alias("n"), F.count_if(_blank(F.try_element_at("provider_ids", F.lit(provider)))).alias("without"), F.count_if(dates).alias("backwards"))
    _refuse(found.where(F.col("instrument_id").isNull() | (F.col("n") > 1)), "repeated or missing instrument ids")
    _refuse(found.where("without > 0"), f"instruments without an id of {provider}")
    _refuse(found.where("backwards > 0"), "instruments that are delisted before their first trade")
    ids = instruments.select("instrument_id", F.explode("provider_ids").alias("provider_id", "provider_instrument_id"))
    _refuse(ids.where(_blank(F.col("provider_id")) | _blank(F.col("provider_instrument_id"))), "blank provider ids")
    _refuse(ids.groupBy("provider_id", "provider_instrument_id").agg(F.count_distinct("instrument_id").alias("n")).where("n > 1"), "provider ids of several instruments")
    _refuse(history.join(instruments.select("instrument_id"), "instrument_id", "left_anti"), "symbols of unknown instruments")
    _refuse(history.where("effective_to < effective_from"), "symbol intervals that end before they begin")
    _refuse(history.groupBy(*_names(HISTORY)).agg(F.count("*").alias("n")).where("n > 1"), "repeated symbol intervals")
    _refuse(history_overlaps(history), "overlapping symbol intervals")


class MasterStore:
    """Instruments and their symbol history; both tables of a version appear together."""

    def __init__(self, spark: SparkSession, path: str):
        self.snapshots = Snapshots(spark, path)

    def promote(self, instruments: DataFrame, history: DataFrame, version: str, provider: str, **facts) -> dict:
        instruments, history = instruments.select(*_names(INSTRUMENT)), history.select(*_names(HISTORY))
        check_master(instruments, history, provider)
        return self.snapshots.promote(version, {"instruments": instruments, "history": history}, provider=provider, **facts)

    def load(self, version: str) -> tuple[DataFrame, DataFrame]:
        """(instruments, history), equal to the manifest and consistent."""
        tables = self.snapshots.load(version)
        check_master(tables["instruments"], tables["history"], self.snapshots.manifest(version)["facts"]["provider"])
        return tables["instruments"], tables["history"]


# ---- corporate actions


def _entries(c: str = "source_fields") -> Column:
    return F.to_json(F.array_sort(F.map_entries(c)))


def normalise_actions(rows: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, unresolved) of provider actions, resolved by exact provider identity alone.

    ``rows`` has provider_id, provider_instrument_id, source_event_id (null for none), action_type, effective_date
    and source_fields (map). An action's id is a name-based UUID of the provider's event, or of type and date where
    there is none. Equal records are one. Two records of one id that differ, or events without a source id that agree
    in instrument, type, date and provider but not in their fields, raise; so do blank ids and field names.
    """
    ids, event = ("provider_id", "provider_instrument_id"), F.col("source_event_id")
    _refuse(rows.where(_blank(F.col(ids[0])) | _blank(F.col(ids[1])) | (event.isNotNull() & (F.trim(event) == ""))), "blank ids of actions")
    _refuse(rows.where(F.exists(F.map_keys("source_fields"), lambda k: F.trim(k) == "")), "blank field names of actions")
    joined = with_instrument(rows, instruments.select("instrument_id", F.explode("provider_ids").alias(*ids)))
    seed = F.concat_ws(":", F.lower(F.trim(ids[0])), F.trim(ids[1]), F.when(event.isNotNull(), F.concat(F.lit("event:"), F.trim(event))).otherwise(F.concat_ws(":", "action_type", F.col("effective_date").cast("string"))))
    known = joined.where("instrument_id is not null").withColumn("action_id", name_uuid("tca_", ACTION_NAMESPACE, seed))
    same = ("instrument_id", "action_type", "effective_date", "provider_id", "source_event_id")
    # one aggregate decides: a record's id must stand for one content
    one = known.groupBy("action_id").agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in same], _entries())).alias("contents"), *[F.min(c).alias(c) for c in same], F.any_value("source_fields").alias("source_fields"))
    one_content = F.when(F.col("contents") > 1, F.raise_error(F.concat(F.lit("conflicting records of action "), F.col("action_id")))).otherwise(F.col("action_id"))
    records = one.withColumn("action_id", one_content).select(*_names(ACTION))
    bare = known.where(event.isNull()).groupBy("instrument_id", "action_type", "effective_date", "provider_id").agg(F.count_distinct(_entries()).alias("n"))
    _refuse(bare.where("n > 1"), "ambiguous actions without a source event")
    unresolved = joined.where("instrument_id is null").select(*ids, "source_event_id", "action_type", "effective_date")
    return records, unresolved


def check_actions(actions: DataFrame, provider: str) -> None:
    """Raise unless action ids are there and unique, all of ``provider``, and no source event has two of them."""
    _refuse(actions.where(_blank(F.col("action_id"))).select("action_id"), "actions without an id")
    _refuse(actions.where(~F.col("provider_id").eqNullSafe(F.lit(provider))).select("action_id", "provider_id"), f"actions of another provider than {provider}")
    _refuse(actions.groupBy("action_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated actions")
    events = actions.where("source_event_id is not null").groupBy("provider_id", "source_event_id").agg(F.count_distinct("action_id").alias("n"))
    _refuse(events.where("n > 1"), "source events of several actions")


class ActionStore:
    """Canonical corporate actions."""

    def __init__(self, spark: SparkSession, path: str):
        self.snapshots = Snapshots(spark, path)

    def promote(self, actions: DataFrame, version: str, provider: str, **facts) -> dict:
        actions = actions.select(*_names(ACTION))
        check_actions(actions, provider)
        span = actions.agg(F.min("effective_date").alias("a"), F.max("effective_date").alias("b")).first()
        return self.snapshots.promote(version, {"actions": actions}, provider=provider, first_date=str(span.a), last_date=str(span.b), **facts)

    def load(self, version: str) -> DataFrame:
        actions = self.snapshots.load(version)["actions"]
        check_actions(actions, self.snapshots.manifest(version)["facts"]["provider"])
        return actions
