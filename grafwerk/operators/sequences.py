"""Running values and ranks over long sequences without a task that holds a whole sequence.

Running values take two passes: rows are dealt by ranges of (group, order), so that a group of
any length lies in as many tasks as it fills; each task runs over its own rows, and what the
tasks before it carry into a group is a table with a row for each task and group that lies in
several tasks, which are fewer than the tasks twice over.

Ranks of chains take pointer jumping: each element's pointer doubles its reach every round, so
a chain of n elements takes log2(n) joins by distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafwerk.plans.store import checkpoint

#: Rows of a range.
RANGE_ROWS = 1_000_000


def _dealt(rows: DataFrame, keys: list[Column], range_rows: int) -> DataFrame:
    """rows with ``__part``, ranges of the keys in order; written, so that parts stay."""
    n = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // range_rows + 1)
    return checkpoint(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, fold: Callable[[Column], Column] = F.sum, inclusive: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with ``name``: the fold (sum, max or min) of ``value`` over the rows before them in
    their group, or up to them; null where there are none. ``order`` must tell rows apart."""
    keys = [F.col(c) for c in group + order]
    held = _dealt(rows.withColumn("__value", value), keys, range_rows)
    names = [f"__g{k}" for k in range(len(group))]
    of_part = held.groupBy("__part", *(F.col(c).alias(n) for c, n in zip(group, names))).agg(fold(F.col("__value")).alias("__total"))
    before = Window.partitionBy(*names).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.withColumnRenamed("__part", "__at")
    if group:
        spread = of_part.groupBy(*(F.col(n).alias(f"{n}s") for n in names)).agg(F.count("*").alias("__n")).where("__n > 1")
        of_part = of_part.join(spread, [F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names], "left_semi")
    carried = of_part.select("__at", *names, fold(F.col("__total")).over(before).alias("__carried"))
    within = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = held.withColumn("__own", fold(F.col("__value")).over(within))
    both = own.join(carried, [F.col("__part") == F.col("__at"), *(F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names))], "left")
    join = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}[fold]
    return both.select(*rows.columns, join(F.col("__own"), F.col("__carried")).alias(name))


def chain_ranks(links: DataFrame) -> DataFrame:
    """id, first, rank of elements (id, old_id): the end of each chain of old_id and the steps
    to it. Elements of which no other is older have rank 0 and are their own end."""
    ids = links.select("id", F.when(F.col("old_id") != F.col("id"), F.col("old_id")).alias("old_id"))
    named = ids.select("old_id").where("old_id is not null").distinct().join(ids.select(F.col("id").alias("old_id")), "old_id", "left_anti")
    state = ids.unionByName(named.select(F.col("old_id").alias("id"), F.lit(None).cast(ids.schema["id"].dataType).alias("old_id")))
    state = checkpoint(state.select("id", F.coalesce("old_id", "id").alias("at"), F.when(F.col("old_id").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.col("old_id").isNull().alias("ended")))
    while True:
        going = state.where("not ended")
        if going.isEmpty():
            return state.select("id", F.col("at").alias("first"), "rank")
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("rank").alias("more"), F.col("ended").alias("there"))
        moved = going.join(ahead, "at").select("id", F.col("then").alias("at"), (F.col("rank") + F.col("more")).alias("rank"), F.col("there").alias("ended"))
        state = checkpoint(state.where("ended").unionByName(moved))
