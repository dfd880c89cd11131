"""Leaderboard change feed by a revenue-band ladder.

Lines of sale are cut into batches by their arrival day, written in the shared folder and fed
in order to one stateful Structured Streaming query, which is started anew for every batch on
one checkpoint. Its state has, for a slice of a nation's items,

- ``revenues``: a MapState from a chunk of items to their revenues,
- ``bands``: a MapState from a band of revenues to the set of items in it. An item of revenue r
  is in band k where 2 ** (k - 1) <= r < 2 ** k; items without positive revenue are in none.

An item changes its set only when its revenue crosses a power of two. After each arrival day
the highest occupied bands are scanned until ``TOP`` items are collected: all items of a band
are above all of the bands below, so that the rest of the ladder is never looked at. Sets and
revenues are packed, and a slice is bounded, so its state is one short row.

A store is opened for every partition at each of the starts. Spark's RocksDB stores don't close
all of their native objects (statistics among them) when they are closed; the state is therefore
kept in the stores that hold a partition's rows on the heap, only while its task runs.

Lines are summed up by item and day in every task before they are shuffled, so a hot item is a
row a task and day. A nation with more than ``SLICE_ROWS`` lines is dealt over as many slices
of items as it takes; each slice gives its own list for a day. A nation's board is the top of
its slices' lists, which foreachBatch ranks (Spark keeps ten rows a task before the shuffle)
and compares with the board of the day before. Lists that stay valid after a batch are kept in
a table of ten rows a slice. Everything of a micro-batch is written under its number, so one
that is repeated after a failure leaves its rows once.

Late lines: ``LATENESS`` days before the largest day of all earlier batches, those of ignored
lines too; what is before is dropped. The limits are twelve numbers known from the cut table.

Defined results: amounts that are not finite or beyond 10 ** 13 count as zero; of repeated
vendors or items the smallest nation and price count; null dates get one from the line's hash;
lines without nation or item are fed and ignored; an empty table gives an empty feed; extra
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grafwerk.llm.shared import checkpoint, lean, remove, shared_dir

TOP, LATENESS = 10, 8
FIRST_DAY, BATCHES, DAYS = 19723, 12, 180
#: Lines of a slice over the whole input; rows held in a task before they are summed up.
SLICE_ROWS, HELD = 50_000, 1 << 18
LARGEST = 1e13
FED = "nation_id int, slice int, item_id long, shipped_day long, arrival_day long, cents long, batch int"
LISTS = "nation_id int, slice int, day long, until long, item_id long, revenue long, listed boolean"
STATE = "revenues binary, bands map<int, binary>"
FEED = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long, batch int"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # stores of a start that has ended would stay on the executors
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
POWERS = np.left_shift(np.int64(1), np.arange(63, dtype=np.int64))


def band_of(revenue: np.ndarray) -> np.ndarray:
    """The bit length of a positive revenue, 0 for others."""
    return np.searchsorted(POWERS, revenue, "right")


class Ladder:
    """For each day of a slice its list of ``top`` items and the items that fell from it."""

    def __init__(self, top: int = TOP):
        self.top = top

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).groupby(["day", "item_id"], sort=True)["cents"].sum()
        day, touched, delta = new.index.get_level_values(0).to_numpy(), new.index.get_level_values(1).to_numpy(), new.to_numpy()
        packed, bands = state.get if state.exists else (b"", {})
        item, revenue = np.frombuffer(packed, np.int64).reshape(2, -1)
        every = np.union1d(item, touched)
        held = np.zeros(len(every), np.int64)
        held[np.searchsorted(every, item)] = revenue
        band = {k: np.frombuffer(v, np.int64) for k, v in bands.items()}
        days, starts = np.unique(day, return_index=True)
        ends = [*starts[1:].tolist(), len(day)]
        shown, out = self._highest(every, held, band), []
        for k, (a, b) in enumerate(zip(starts.tolist(), ends)):
            at = np.searchsorted(every, touched[a:b])
            old = band_of(held[at])
            held[at] += delta[a:b]
            now = band_of(held[at])
            moved = old != now
            for n in np.unique(old[moved & (old > 0)]).tolist():
                band[n] = np.setdiff1d(band[n], every[at[moved & (old == n)]], assume_unique=True)
            for n in np.unique(now[moved & (now > 0)]).tolist():
                band[n] = np.union1d(band.get(n, np.zeros(0, np.int64)), every[at[moved & (now == n)]])
            listed = self._highest(every, held, band)
            fell = np.setdiff1d(shown, listed)
            rows_of = np.concatenate([listed, fell])
            until = int(days[k + 1]) if k + 1 < len(days) else None
            out.append((int(days[k]), until, rows_of, held[np.searchsorted(every, rows_of)], len(listed)))
            shown = listed
        state.update((np.stack([every, held]).tobytes(), {k: v.tobytes() for k, v in band.items() if len(v)}))
        count = [len(x[2]) for x in out]
        made = {"nation_id": np.full(sum(count), key[0], np.int32), "slice": np.full(sum(count), key[1], np.int32), "day": np.repeat([x[0] for x in out], count)}
        made["until"] = pd.array(np.repeat(np.array([x[1] for x in out], object), count), "Int64")
        made |= {"item_id": np.concatenate([x[2] for x in out]), "revenue": np.concatenate([x[3] for x in out]), "listed": np.concatenate([np.arange(len(x[2])) < x[4] for x in out])}
        yield pd.DataFrame(made)

    def _highest(self, every: np.ndarray, held: np.ndarray, band: dict[int, np.ndarray]) -> np.ndarray:
        """The top items, best first: bands from the highest until enough are collected."""
        got, n = [], 0
        for k in sorted(band, reverse=True):
            got.append(band[k])
            n += len(band[k])
            if n >= self.top:
                break
        found = np.concatenate([np.zeros(0, np.int64), *got])
        return found[np.lexsort([found, -held[np.searchsorted(every, found)]])[: self.top]]


def summed(lines: DataFrame) -> DataFrame:
    """nation_id, slice, day, item_id, cents: sums of each task, which hold few rows at a time."""

    def sums(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = ["nation_id", "slice", "day", "item_id"]
        found = pa.Table.from_batches(held).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])
        return found.combine_chunks().to_batches()[0]

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held += [batch] * bool(len(batch))
            n += len(batch)
            if n > HELD:
                held = [sums(held)]
                n = len(held[0])
                if n > HELD // 2:  # hardly any repeats
                    yield held.pop()
                    n = 0
        if held:
            yield sums(held)

    return lines.select("nation_id", "slice", F.col("arrival_day").alias("day"), "item_id", "cents").mapInArrow(run, "nation_id int, slice int, day long, item_id long, cents long")


def ranked(lists: DataFrame, carried: DataFrame, days: list[int], top: int = TOP) -> DataFrame:
    """Changes of each nation's board on each of these days, from the slices' lists of the
    days and those that were valid before."""
    marks = [days[0] - 1, *days]
    following = F.create_map(*(F.lit(x).cast("long") for pair in zip(marks, days) for x in pair))
    first = lists.groupBy("nation_id", "slice").agg(F.min("day").alias("first"))
    kept = carried.join(first, ["nation_id", "slice"], "left")
    spans = kept.select("nation_id", "item_id", "revenue", F.lit(marks[0]).cast("long").alias("day"), F.col("first").alias("until"))
    spans = spans.unionByName(lists.where("listed").select("nation_id", "item_id", "revenue", "day", "until"))
    within = F.filter(F.array(*(F.lit(m).cast("long") for m in marks)), lambda m: (m >= F.col("day")) & (m < F.coalesce("until", F.lit(marks[-1] + 1))))
    valid = spans.select("nation_id", "item_id", "revenue", F.explode(within).alias("day"))
    place = F.row_number().over(Window.partitionBy("nation_id", "day").orderBy(F.desc("revenue"), "item_id"))
    board = valid.withColumn("rank", place).where(F.col("rank") <= top)
    none = F.lit(None).cast("int")
    now = F.struct(F.col("day").alias("arrival_day"), none.alias("old_rank"), F.col("rank").alias("new_rank"), F.lit(True).alias("now"))
    later = F.struct(F.try_element_at(following, F.col("day")).alias("arrival_day"), F.col("rank").alias("old_rank"), none.alias("new_rank"), F.lit(False).alias("now"))
    seen = board.select("nation_id", "item_id", "revenue", F.explode(F.array(now, later)).alias("x")).select("nation_id", "item_id", "x.*", F.when(F.col("x.now"), F.col("revenue")).alias("revenue")).drop("now")
    fell = lists.where("not listed").select("nation_id", "item_id", F.col("day").alias("arrival_day"), none.alias("old_rank"), none.alias("new_rank"), "revenue")
    listed = valid.select("nation_id", "item_id", F.col("day").alias("arrival_day"), none.alias("old_rank"), none.alias("new_rank"), "revenue")
    changed = seen.unionByName(fell).unionByName(listed).where(F.col("arrival_day") > marks[0]).groupBy("nation_id", "arrival_day", "item_id").agg(F.max("old_rank").alias("old_rank"), F.max("new_rank").alias("new_rank"), F.max("revenue").alias("revenue"))
    kind = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return changed.where(~F.col("old_rank").eqNullSafe(F.col("new_rank"))).select("nation_id", "arrival_day", "item_id", kind.alias("change"), "old_rank", "new_rank", "revenue")


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"{source} could not become {target}")


def change_feed(lines: DataFrame, top: int = TOP, lateness: int = LATENESS) -> DataFrame:
    """The feed of ``lines`` (the columns of FED), which are fed a batch at a time.

    Every call has a folder of its own in the shared one, of which the feed stays."""
    spark = lines.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/leaderboard-{uuid.uuid4().hex}"
    lines.select(*(c.split()[0] for c in FED.split(", "))).write.partitionBy("batch").parquet(f"{folder}/cut")
    cut = spark.read.schema(FED).parquet(f"{folder}/cut")
    largest = {r["batch"]: r["day"] for r in cut.groupBy("batch").agg(F.max("shipped_day").alias("day")).collect()}
    limits = {b: max((d for c, d in largest.items() if c < b and d is not None), default=None) for b in largest}
    spark.createDataFrame([], LISTS).write.parquet(f"{folder}/open/none")
    opened = ["none"]

    def merge(lists: DataFrame, number: int, batch: int) -> None:
        lists.write.mode("overwrite").parquet(f"{folder}/lists/{number}")  # the state is asked once
        found, carried = spark.read.schema(LISTS).parquet(f"{folder}/lists/{number}"), spark.read.schema(LISTS).parquet(f"{folder}/open/{opened[-1]}")
        days = sorted(r["day"] for r in found.select("day").distinct().collect())
        if not days:
            return
        ranked(found, carried, days, top).write.mode("overwrite").parquet(f"{folder}/feed/batch={batch}/number={number}")
        renewed = found.select("nation_id", "slice").distinct()
        rest = carried.join(renewed, ["nation_id", "slice"], "left_anti")
        found.where("listed and until is null").unionByName(rest).write.mode("overwrite").parquet(f"{folder}/open/{number}")
        opened.append(str(number))

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        late = F.lit(False)
        for b, d in limits.items():
            if d is not None:
                late = late | ((F.col("batch") == b) & (F.col("shipped_day") + lateness < d))
        for b in sorted(largest):
            _mkdirs(spark, f"{folder}/fed")
            _move(spark, f"{folder}/cut/batch={b}", f"{folder}/fed/batch={b}")
            fed = spark.readStream.schema(FED).parquet(f"{folder}/fed").where(~late & F.col("nation_id").isNotNull() & F.col("item_id").isNotNull())
            lists = summed(fed).groupBy("nation_id", "slice").applyInPandasWithState(Ladder(top), LISTS, STATE, "append", GroupStateTimeout.NoTimeout)
            query = lists.writeStream.foreachBatch(lambda x, n, b=b: merge(x, n, b)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _mkdirs(spark, f"{folder}/feed")
    feed = spark.read.schema(FEED).parquet(f"{folder}/feed").drop("number")
    for name in ("cut", "fed", "lists", "open", "state"):
        remove(spark, f"{folder}/{name}")
    return feed


def _mkdirs(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _cents(money: Column) -> Column:
    return F.when(F.abs(money) <= LARGEST, F.floor(F.lit(100.0) * money + 0.5).cast("long")).when(money.isNotNull(), F.lit(0).cast("long"))


def staged(lines: DataFrame, vendors: DataFrame, items: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Lines of sale as FED: with their nation and its slice of items, days and batch."""
    named = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(named)
    day = F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("long"), FIRST_DAY + h % 150)
    arrival = F.col("shipped_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    dated = lines.select("vendor_id", "item_id", day.alias("shipped_day"), h.alias("h"), "flag", _cents(F.col("amount")).alias("amount"), F.when(F.col("amount").isNull(), F.col("quantity").cast("long")).alias("quantity"))
    narrow = dated.withColumn("arrival_day", arrival).select("vendor_id", "item_id", "shipped_day", "arrival_day", batch.alias("batch"), "amount", "quantity", F.when(F.col("flag") == "returned", -1).otherwise(1).alias("sign"))
    places = vendors.where("vendor_id is not null and nation_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    places = checkpoint(places.join(lines.groupBy("vendor_id").agg(F.count("*").alias("n")), "vendor_id"))
    slices = places.groupBy("nation_id").agg(F.ceil(F.sum("n") / slice_rows).cast("int").alias("slices"))
    places = checkpoint(places.join(slices, "nation_id").select("vendor_id", "nation_id", "slices"))
    prices = checkpoint(items.where("item_id is not null").groupBy("item_id").agg(_cents(F.min("price")).alias("price")).withColumn("known", F.lit(True)))
    found = narrow.join(places, "vendor_id", "left").join(prices, "item_id", "left")
    cents = F.col("sign") * F.coalesce("amount", F.col("quantity") * F.col("price"), F.lit(0))
    return found.select(F.when(F.col("known"), F.col("nation_id")).alias("nation_id"), F.pmod(F.xxhash64("item_id"), F.col("slices")).cast("int").alias("slice"), "item_id", "shipped_day", "arrival_day", cents.cast("long").alias("cents"), "batch")
