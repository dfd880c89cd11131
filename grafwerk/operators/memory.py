"""Memory records: score, tiers, decay, supersession, consolidation.

Records have id, type, title, body, tags, created (timestamp), confidence, critic, origin,
status, is_latest. All ages are taken at an ``as_of`` timestamp, so results do not drift.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafwerk.operators import sequences, similar, vector
from grafwerk.plans.store import checkpoint

#: Weights of the signals, days until freshness halves, tier and archive limits.
WEIGHTS = {"graph": 0.25, "refs": 0.20, "confidence": 0.15, "critic": 0.20, "freshness": 0.05, "reinforcement": 0.05, "authority": 0.10}
HALF_LIFE = {"decision": 90.0}
HALF_LIFE_ELSE = 270.0
RAW_BELOW, DRAFT_BELOW = 0.3, 0.5
RAW_DAYS, TRIBAL_DAYS, PURGE_DAYS = 7, 90, 90
#: Cosine from which a new text replaces an old one.
SIMILAR = 0.85


def age_days(created: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000.0


def freshness(kind: Column, created: Column, origin: Column, as_of: Column) -> Column:
    half = F.when(kind == "decision", HALF_LIFE["decision"]).otherwise(HALF_LIFE_ELSE)
    value = F.exp(-math.log(2) * F.greatest(age_days(created, as_of), F.lit(0.0)) / half)
    return F.when(origin == "manual", 1.0).when(created.isNull(), 0.5).otherwise(value)


def refs_signal(refs: DataFrame) -> DataFrame:
    """id, refs: distinct sessions that referred to a record, five or more count as one."""
    return refs.groupBy("id").agg(F.least(F.count_distinct("session") / 5.0, F.lit(1.0)).alias("refs"))


def reinforcement(refs: DataFrame, as_of: Column) -> DataFrame:
    """id, reinforcement: 0.3 times the sum of 1 / days since each reference, at most 1."""
    days = F.greatest(age_days(F.col("at"), as_of), F.lit(1.0))
    return refs.groupBy("id").agg(F.least(0.3 * F.sum(1 / days), F.lit(1.0)).alias("reinforcement"))


def score(signals: dict[str, Column]) -> Column:
    return F.round(sum((F.coalesce(signals[k], F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 3)


def tier(value: Column) -> Column:
    return F.when(value < RAW_BELOW, "raw").when(value < DRAFT_BELOW, "drafts").otherwise("tribal")


def scored(records: DataFrame, refs: DataFrame, as_of: Column) -> DataFrame:
    """Records with all signals, score and tier."""
    rows = records.join(refs_signal(refs), "id", "left").join(reinforcement(refs, as_of), "id", "left")
    signals = {
        "graph": F.coalesce("graph", F.lit(1.0)),
        "refs": F.col("refs"),
        "confidence": F.col("confidence"),
        "critic": F.col("critic"),
        "freshness": freshness(F.col("type"), F.col("created"), F.col("origin"), as_of),
        "reinforcement": F.col("reinforcement"),
        "authority": F.when(F.col("origin") == "manual", 1.0).otherwise(0.5),
    }
    return rows.withColumn("score", score(signals)).withColumn("tier", tier(F.col("score")))


def decayed(records: DataFrame, as_of: Column) -> DataFrame:
    """status after decay: raw and tribal records past their days are archived."""
    age = age_days(F.col("created"), as_of)
    old = ((F.col("tier") == "raw") & (age > RAW_DAYS)) | ((F.col("tier") == "tribal") & (age > TRIBAL_DAYS))
    return records.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))


def purged(records: DataFrame, as_of: Column) -> DataFrame:
    return records.where(~((F.col("status") == "archived") & (age_days(F.col("created"), as_of) > PURGE_DAYS)))


def batch_critic(drafts: DataFrame) -> DataFrame:
    """What happens to each draft: archived, promoted or kept."""
    return drafts.withColumn("action", F.when(F.col("score") < RAW_BELOW, "archive").when(F.col("score") >= DRAFT_BELOW, "promote").otherwise("keep"))


def consolidated(records: DataFrame) -> DataFrame:
    """Records of one title (whatever its case) merged: distinct bodies, all tags."""
    key = F.lower(F.trim("title"))
    groups = records.groupBy(key.alias("title_key")).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.array_sort(F.collect_set("body")).alias("bodies"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    return groups.where("n >= 2").select("id", "title_key", "n", F.array_join("bodies", "\n---\n").alias("body"), F.array_join("tags", ",").alias("tags"))


def superseded(new: DataFrame, held: DataFrame, threshold: float = SIMILAR, range_rows: int = sequences.RANGE_ROWS) -> DataFrame:
    """new_id, old_id, via: the latest record of the same type with a smaller id that a new one
    replaces: the newest of the same title (whatever its case; titles that are blank match
    none), else the nearest text of cosine ``threshold`` or more by hashed words.

    The newest of a title is a running maximum, so a title that all records have is no pairs."""
    titled = lambda df, ask: df.select("type", F.lower(F.trim("title")).alias("k"), "id", F.lit(ask).alias("ask"))
    latest = held.where("is_latest")
    events = titled(latest, 1).unionByName(titled(new, 0)).where("k <> ''")
    before = sequences.running(events, ["type", "k"], ["id", "ask"], F.when(F.col("ask") == 1, F.col("id")), "old_id", F.max, range_rows=range_rows)
    by_title = checkpoint(before.where("ask = 0 and old_id is not null").groupBy(F.col("id").alias("new_id")).agg(F.max("old_id").alias("old_id")))
    text = lambda df, *cols: F.concat_ws(" ", *(F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in cols if c in df.columns))
    of = lambda df: text(df, "title", "description", "body")
    untitled = lambda df: df.join(by_title.select(F.col("new_id").alias("id")), "id", "left_anti")
    if any(not df.groupBy("id").count().where("id is not null and count > 1").isEmpty() for df in ([new] if new is held else [new, held])):
        embed = lambda df, t: vector.hash_embed(df.select("id", t.alias("t")), "id", F.col("t")).join(df.select("id", F.col("type").alias("block")), "id")
        near = similar.best_match(embed(untitled(new), text(new, "title", "body")), embed(latest, of(latest)), threshold)
    else:
        packed = lambda df, t: checkpoint(vector.hash_packed(df.select("id", F.col("type").alias("block"), "is_latest", t.alias("t")), "id", F.col("t"), ["block", "is_latest"]))
        old = packed(held if new is held else latest, of(held))
        asking = old if new is held and "description" not in new.columns else packed(new, text(new, "title", "body"))
        near = similar.nearest(untitled(asking), old.where("is_latest"), threshold, 256)
    by_text = near.select(F.col("id").alias("new_id"), F.col("other").alias("old_id"))
    return by_title.withColumn("via", F.lit("title")).unionByName(by_text.withColumn("via", F.lit("text")))


def version_chain(records: DataFrame, links: DataFrame) -> DataFrame:
    """records with old_id (the record that each replaces: links new_id, old_id), first (the
    oldest of its chain), versions (how many are older) and is_latest (none replaces it).

    One row a record: a chain is its links, and ``lineage`` lists it for one record."""
    own = records.drop("is_latest", "old_id").join(links.select(F.col("new_id").alias("id"), "old_id"), "id", "left")
    ranks = sequences.chain_ranks(own.select("id", "old_id")).withColumnRenamed("rank", "versions")
    newer = links.select(F.col("old_id").alias("id"), F.lit(True).alias("__newer")).distinct()
    return own.join(ranks, "id").join(newer, "id", "left").withColumn("is_latest", F.col("__newer").isNull()).drop("__newer")


def lineage(chains: DataFrame, record_id: int) -> DataFrame:
    """The versions that led to one record, newest first."""
    first = F.broadcast(chains.where(F.col("id") == record_id).select("first", F.col("versions").alias("upto")))
    return chains.join(first, "first").where((F.col("versions") < F.col("upto")) | (F.col("id") == record_id)).orderBy(F.desc("versions"), "id").select("id", "versions")


def digest(records: DataFrame, top: int = 10) -> DataFrame:
    return records.where("tier = 'tribal'").orderBy(F.desc("score"), "id").limit(top)


def tier_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


def transcripts(conversations: DataFrame, cap: int = 8000) -> DataFrame:
    """A session's turns in order as one text of at most ``cap`` characters."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.left(F.array_join(F.transform(turns, lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n"), F.lit(cap)).alias("transcript"))
