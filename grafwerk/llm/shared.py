"""What several operators need of the session and of their input tables."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; the bytes keep a batch of very long texts small.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: A key with over a HEAVY-th of all rows is dealt over as many tasks as bring it below that.
HEAVY = 1000
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def prepare(spark: SparkSession) -> None:
    """Arrow batches of bounded size, and a checkpoint folder where the session names none."""
    for name, value in BATCH_CONF.items():
        spark.conf.set(name, value)
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session names none,
    one in the warehouse, which is shared too; a temporary one if all runs in this process."""
    context = spark.sparkContext
    set_here = context._jsc.sc().getCheckpointDir()
    if set_here.isDefined():
        return set_here.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        here = context.master.split("[")[0] == "local"
        named = tempfile.mkdtemp(prefix="checkpoint") if here else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get() or named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run in the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def lean(run: Batches) -> Batches:
    """``run`` in a worker that gives freed memory back when its task ends; workers are kept
    for later stages and would hold on to the largest batch that they ever saw."""

    @wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that the DataFrame has no column of, whatever the case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for a key and its number of
    rows, n. The rows of a heavy key, one with over a HEAVY-th of all, are dealt by a hash of
    ``by`` over tasks that get a HEAVY-th each; fewer than HEAVY keys can be heavy, so those
    are broadcast, and all of them have fewer than 2 * HEAVY copies."""
    facts = checkpoint(facts)
    share = F.lit(float(facts.agg(F.sum("n")).first()[0] or 0) / HEAVY)
    heavy = facts.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("__salts"))
    if heavy.isEmpty():
        return rows.join(facts.drop("n"), keys, how)
    marked = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    every = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    copies = facts.drop("n").join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.explode(every)).drop("__salts")
    return marked.join(copies, [*keys, "__salt"], how).drop("__salt")


def sampled(rows: DataFrame, n: int, sample: int, *by: str) -> DataFrame:
    """About ``sample`` of n rows by a hash of columns; no task gives more than its share."""
    share = min(1.0, sample / max(n, 1))
    return rows.where(F.shiftrightunsigned(F.xxhash64(*by, F.lit("sample")), 33) < F.lit(int(share * 2**31)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
