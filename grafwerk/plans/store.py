"""The built graph of a session: its edges are resolved once, when first needed, and cut off
with a checkpoint."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StringType

from grafwerk.sources.views import Graph, from_tables

_built: dict[tuple[str, str], tuple[object, Graph]] = {}
_cut: WeakKeyDictionary[DataFrame, dict[str, DataFrame]] = WeakKeyDictionary()
_stored: WeakKeyDictionary[DataFrame, dict[str, object]] = WeakKeyDictionary()
SOURCES = ("nation", "supplier", "part", "lineitem")
#: Bytes of files that a join may take for small before it has measured them.
GUESSED = 256 << 10
#: Bytes of a stored table up to which joins are not told its size, which is that of packed rows.
PACKED = 8 << 20
#: Folders that the present ``scratch`` removes at its end.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: The session's setting that removes an action's shuffle files once the action is over.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame, packed: bool = False) -> DataFrame:
    """Cut the lineage in spark.checkpoint.dir; where the session has none, in the warehouse,
    or in a temporary folder if all runs in this process.

    Rows with text are stored as Parquet: a checkpoint's rows are neither packed nor read by
    column, and names that repeat fill the disk. Rows of numbers keep how they are dealt, unless
    they are to be ``packed`` too."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    tidy(spark)
    kinds = [f.dataType for f in df.schema.fields]
    if not (packed or any(isinstance(k, StringType) for k in kinds)) or any(isinstance(k, NullType) for k in kinds):
        return df.checkpoint()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}")
    (path.getFileSystem(spark._jsc.hadoopConfiguration())).deleteOnExit(path)
    if (held := _scratch.get()) is not None:
        held.append(path.toString())
    df.write.option("compression", "zstd").parquet(path.toString())
    read = spark.read.schema(df.schema).parquet(path.toString())
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() > PACKED:
        return read
    session = spark._jsparkSession
    return DataFrame(session.internalCreateDataFrame(read._jdf.queryExecution().toRdd(), read._jdf.schema(), False), spark)


def tidy(spark: SparkSession) -> None:
    """Shuffle files go when their action is over, not when the driver happens to collect its
    garbage, unless the session says otherwise."""
    if not spark.sparkContext.getConf().contains(TIDY):
        spark.conf.set(TIDY, "true")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables with text that are cut off within are removed at the end, but for those cut off by
    the function that this gives."""
    outer = _scratch.get()
    own: list[str] = []
    token = _scratch.set(own)

    def kept(df: DataFrame) -> DataFrame:
        inner = _scratch.set(outer)
        try:
            return checkpoint(df)
        finally:
            _scratch.reset(inner)

    try:
        yield kept
    finally:
        _scratch.reset(token)
        for p in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(rows: DataFrame, key: list[str], make: Callable[..., DataFrame], most: int, parts: int = 16) -> DataFrame:
    """What ``make`` derives from slices of ``rows``. It is given a function that takes the same
    slice, by a hash of the key, of any table that has the key, and one that cuts off what must
    outlast the slice. Each slice is cut off before the next begins, so that what is exchanged
    for one is on disk at a time. Slices have about ``most`` rows, above ``parts`` times that more."""
    n = max(1, min(parts, -(-rows.count() // most)))
    found = None
    for k in range(n):
        part = lambda df, k=k: df if n == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k)
        with scratch(rows.sparkSession) as kept:
            cut = kept(make(part, kept))
        found = cut if found is None else found.unionByName(cut)
    return found


def checkpoint_folder(spark: SparkSession) -> None:
    """Name the folder where the session has not yet used it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            here = context.master.split("[")[0] == "local"
            named = tempfile.mkdtemp(prefix="checkpoint") if here else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        context.setCheckpointDir(named)


def cut_once(owner: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` derives from a DataFrame, checkpointed the first time it is asked for."""
    held = _cut.setdefault(owner, {})
    if name not in held:
        held[name] = checkpoint(make())
    return held[name]


def stored_once(owner: DataFrame, name: str, write: Callable[[str], object]) -> object:
    """What ``write`` stores in a folder of its own in the shared one, the first time it is
    asked for."""
    held = _stored.setdefault(owner, {})
    if name not in held:
        checkpoint_folder(owner.sparkSession)
        held[name] = write(f"{owner.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}")
    return held[name]


def _stamp(spark: SparkSession, sf_dir: str) -> object:
    """Names, sizes and times of the files of the graph's tables."""
    found = []
    for name in SOURCES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def measured_joins(spark: SparkSession) -> None:
    """Let the session's joins broadcast what the session allows by measured sizes, by those of
    files only up to GUESSED: columns that repeat few values are a thirtieth of their rows in
    a file, and the driver would hold the rows."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", most.strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > GUESSED:
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(GUESSED))


class Built(Graph):
    """A graph whose edges are cut off, and resolved, when they are first asked for: questions
    about files and symbols cost neither."""

    def __init__(self, derived: Graph) -> None:
        self.__dict__.update(repos=derived.repos, files=derived.files, symbols=derived.symbols, imports=derived.imports, derived=derived)

    @cached_property
    def raw_edges(self) -> DataFrame:
        return checkpoint(self.derived.raw_edges)

    @cached_property
    def edges(self) -> DataFrame:
        from grafwerk.operators.resolve import resolved_in_slices

        return resolved_in_slices(self)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.repos, self.files, self.symbols, self.imports, self.raw_edges, edges)


def build(spark: SparkSession, sf_dir: str) -> Graph:
    """Derive the graph, whose edges are resolved once they are needed; later calls of a session
    reuse the result while the files of the tables are the same."""
    measured_joins(spark)
    tidy(spark)
    key, stamp = (spark.sparkContext.applicationId, sf_dir), _stamp(spark, sf_dir)
    if key not in _built or _built[key][0] != stamp:
        _built[key] = (stamp, Built(from_tables(spark, sf_dir)))
    return _built[key][1]


@contextmanager
def build_lock(spark: SparkSession, path: str):
    """One build of a stored graph at a time: a lock file that only one caller can create."""
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.build.lock")
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    if lock.getParent() is not None:
        fs.mkdirs(lock.getParent())
    if not fs.createNewFile(lock):
        raise RuntimeError(f"another build is in progress; if it is not, remove {lock.toString()}")
    try:
        yield
    finally:
        fs.delete(lock, False)


def replace(graph: Graph, path: str) -> None:
    """Save the graph beside the stored one and put it in its place once it is whole, under
    the lock; readers find the old one until then."""
    spark = graph.symbols.sparkSession
    where = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    path = path.rstrip("/")
    with build_lock(spark, path):
        fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
        write(graph, f"{path}.new")
        fs.delete(where(f"{path}.old"), True)
        if fs.exists(where(path)) and not fs.rename(where(path), where(f"{path}.old")):
            raise OSError(f"{path} can't be moved away")
        if not fs.rename(where(f"{path}.new"), where(path)):
            fs.rename(where(f"{path}.old"), where(path))
            raise OSError(f"{path}.new can't be put in place")
        fs.delete(where(f"{path}.old"), True)


def write(graph: Graph, path: str) -> None:
    """Save the graph as parquet; edges and symbols are laid out by repository."""
    for name in ("repos", "files", "symbols", "imports", "raw_edges", "edges"):
        if (df := getattr(graph, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
