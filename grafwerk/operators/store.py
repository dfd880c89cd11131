"""Memory records behind a store protocol: one over parquet, one in memory for tests.

A record is a dict with id, type, title, body, tags and tier.
"""

from __future__ import annotations

import re
import uuid
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafwerk.operators.incremental import upsert

FIELDS = "id string, type string, title string, body string, tags array<string>, tier string"
TIERS = ("raw", "drafts", "tribal", "archived")


@runtime_checkable
class MemoryStore(Protocol):
    """All that a record's life cycle asks of where records are kept."""

    def add(self, record: dict, tier: str | None = None, old_id: str | None = None) -> str: ...

    def get(self, record_id: str) -> dict | None: ...

    def search(self, tier: str | None = None, tag: str | None = None) -> DataFrame: ...

    def update(self, record: dict, tier: str | None = None, old_id: str | None = None) -> str: ...

    def delete(self, record_id: str) -> bool: ...


def _named(record: dict, tier: str | None) -> dict:
    own = {"id": None, "type": "Memory", "title": "", "body": "", "tags": [], "tier": "drafts"} | record
    own["tier"] = tier or own["tier"]
    if own["tier"] not in TIERS:
        raise ValueError(f"no tier {own['tier']}")
    if not own["id"]:
        slug = re.sub("[^a-z0-9]+", "-", own["title"].lower()).strip("-")[:60]
        own["id"] = f"memory/{own['tier']}/{slug}-{uuid.uuid4().hex[:6]}"
    return own


class LocalStore:
    """Records in a dict, for tests and small sets."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, {}

    def add(self, record: dict, tier: str | None = None, old_id: str | None = None) -> str:
        own = _named(record, tier)
        self.held[own["id"]] = own
        if old_id and old_id != own["id"]:
            self.held.pop(old_id, None)
        return own["id"]

    update = add

    def get(self, record_id: str) -> dict | None:
        return self.held.get(record_id)

    def search(self, tier: str | None = None, tag: str | None = None) -> DataFrame:
        rows = [tuple(r[f.split()[0]] for f in FIELDS.split(", ")) for r in self.held.values()]
        return _wanted(self.spark.createDataFrame(rows, FIELDS), tier, tag)

    def delete(self, record_id: str) -> bool:
        return self.held.pop(record_id, None) is not None


class TableStore:
    """Records as an append-only parquet table of versions; reading takes each id's latest, so
    writers never rewrite what readers may be reading. ``compact`` writes the latest anew."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, records: DataFrame, gone: bool) -> None:
        records.withColumn("at", F.current_timestamp()).withColumn("turn", F.lit(uuid.uuid1().time)).withColumn("gone", F.lit(gone)).write.mode("append").parquet(self.path)

    def add_all(self, records: DataFrame) -> None:
        """A whole DataFrame of records (the columns of FIELDS) at once."""
        self._append(records.select(*(f.split()[0] for f in FIELDS.split(", "))), False)

    def add(self, record: dict, tier: str | None = None, old_id: str | None = None) -> str:
        own = _named(record, tier)
        self.add_all(self.spark.createDataFrame([tuple(own[f.split()[0]] for f in FIELDS.split(", "))], FIELDS))
        if old_id and old_id != own["id"]:
            self.delete(old_id)
        return own["id"]

    update = add

    def latest(self) -> DataFrame:
        rows = self.spark.read.schema(f"{FIELDS}, at timestamp, turn long, gone boolean").parquet(self.path)
        rows = rows.withColumn("version", F.struct("at", "turn"))
        return upsert(rows, rows.limit(0), ["id"], "version").where("not gone").drop("at", "turn", "gone", "version")

    def get(self, record_id: str) -> dict | None:
        found = self.latest().where(F.col("id") == record_id).first()
        return found.asDict() if found else None

    def search(self, tier: str | None = None, tag: str | None = None) -> DataFrame:
        return _wanted(self.latest(), tier, tag)

    def delete(self, record_id: str) -> bool:
        found = self.get(record_id)
        if found:
            self._append(self.spark.createDataFrame([tuple(found[f.split()[0]] for f in FIELDS.split(", "))], FIELDS), True)
        return found is not None

    def compact(self, path: str) -> None:
        TableStore(self.spark, path).add_all(self.latest())


def _wanted(records: DataFrame, tier: str | None, tag: str | None) -> DataFrame:
    rows = records if tier is None else records.where(F.col("tier") == tier)
    return rows if tag is None else rows.where(F.array_contains("tags", tag))
