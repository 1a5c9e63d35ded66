"""Pending work of a stream of requests: a keyed state machine with a quiet time, one state a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.operators.work import CLASSES

#: The provider of state that transformWithState needs; set it as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, op string, seq long, size long"


class PendingWork(StatefulProcessor):
    """A key's state is the request that is queued for it: its kind, its place and the key's last size.

    A request of the queued kind leaves the place alone, one of the other kind takes it. Each request puts the key off by
    the quiet time; when that is over, the work is handed out and the key forgotten.
    """

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queued = handle.getValueState("queued", "op string, seq long, size long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("seq")
        op, seq, size, due = self.queued.get() if self.queued.exists() else (None, None, None, None)
        for r in asked[asked["op"].isin(list(CLASSES))].itertuples():
            if r.op != op:
                op, seq = r.op, int(r.seq)
            size = None if pd.isna(r.size) else int(r.size)
        if op is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
            self.handle.registerTimer(due)
            self.queued.update((op, seq, size, due))
        yield pd.DataFrame(columns=["key", "op", "seq", "size"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.queued.exists():
            op, seq, size, _ = self.queued.get()
            self.queued.clear()
            yield pd.DataFrame({"key": [key[0]], "op": [op], "seq": [seq], "size": pd.array([size], "Int64")})
        else:
            yield pd.DataFrame(columns=["key", "op", "seq", "size"])

    def close(self) -> None:
        pass


def pending_stream(requests: DataFrame, quiet_ms: int = 400) -> DataFrame:
    """key, op, seq, size of the work of each key, once it was quiet for so long: pending() for a stream of (seq, key, op, size).

    Rows without a key, or of another kind, ask for nothing. Batches must come in order of seq for a key.
    """
    keyed = requests.where("key is not null").selectExpr("cast(key as string) as key", "op", "cast(seq as long) as seq", "cast(size as long) as size")
    return keyed.groupBy("key").transformWithStateInPandas(PendingWork(quiet_ms), StructType.fromDDL(OUTPUT), "append", "ProcessingTime")
