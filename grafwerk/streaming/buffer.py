"""A buffer of metric rows before the table: written when full or when a while has passed.

Rows wait in the state of a stream, by tool and shard. ``ROWS`` of them, or the oldest waiting
for ``SECONDS``, are let through together and only then leave the state, in the same commit as
the batch that wrote them. The sink keeps a micro-batch's rows under the batch's number and
replaces what is there, so a batch that is repeated after a failure between write and commit
leaves no row twice and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROWS, SECONDS, SHARDS = 2000, 30.0, 8
ROW = "event_id long, tool string, session long, at timestamp, duration_ms double, status string"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Buffer(StatefulProcessor):
    def __init__(self, rows: int = ROWS, seconds: float = SECONDS):
        self.rows, self.millis = rows, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        first = not held
        for frame in rows:
            held += list(frame[[c.split()[0] for c in ROW.split(", ")]].astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
        out = held[: len(held) // self.rows * self.rows]
        rest = held[len(out) :]
        for at in self.handle.listTimers():
            if out or not rest:
                self.handle.deleteTimer(at)
        if rest:
            self.waiting.put(rest)
            if first or out:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        else:
            self.waiting.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.waiting.clear()
        yield self._frame(held)

    def _held(self) -> list[tuple]:
        return list(self.waiting.get()) if self.waiting.exists() else []

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])
        return frame.astype({"event_id": "Int64", "session": "Int64", "duration_ms": "float64"}).assign(at=pd.to_datetime(frame["at"]))

    def close(self) -> None:
        pass


def buffered(stream: DataFrame, rows: int = ROWS, seconds: float = SECONDS, shards: int = SHARDS) -> DataFrame:
    """The rows (ROW) of a stream, in groups as the buffer lets them through."""
    sharded = stream.select(*(c.split()[0] for c in ROW.split(", "))).withColumn("shard", F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int")).withColumn("by", F.col("tool"))
    return sharded.groupBy("by", "shard").transformWithStateInPandas(Buffer(rows, seconds), ROW, "Append", "ProcessingTime")


def write(stream: DataFrame, folder: str, every: str = "1 second", before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Append a buffered stream to ``folder``/rows, a part for each micro-batch."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        if before_commit is not None:
            before_commit(number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(processingTime=every).start()


def written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{ROW}, batch long").parquet(f"{folder}/rows")
