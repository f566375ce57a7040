"""Counters of a query clock as keyed stream state: probation and cooldown of sources."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "q long, source long, evicted boolean"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that counters need, while a stream is started; what the session had comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Counters(StatefulProcessor):
    """State of a source: how often it was asked since its last promotion, until which query it is cooling down, and, by
    query, the accesses it has answered, so that one which arrives twice is answered once.

    Both counters are timers of the query clock: a promotion clears the first, a query at or after its end the second, so a source
    at rest holds none.  A remembered access is forgotten `memory` queries later.
    """

    def __init__(self, limit: int, cooldown: int, memory: int):
        self.limit, self.cooldown, self.memory = limit, cooldown, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int")
        self.until = handle.getValueState("until", "q long")
        self.answered = handle.getMapState("answered", "q long", "seen int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["q", "evicted"], ascending=[True, False])  # an eviction holds for its own query
        seen = self.seen.get()[0] if self.seen.exists() else 0
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for q, evicted in zip(f["q"].tolist(), f["evicted"].tolist(), strict=True):
            if evicted:
                until = max(until or 0, q + self.cooldown)
                continue
            if self.answered.containsKey((q,)):
                continue
            if until is not None and q >= until:
                until = None
            seen = seen + 1
            out.append((q, key[0], seen, int(seen >= self.limit), int(until is not None and until - self.cooldown <= q)))
            self.answered.updateValue((q,), (seen,))
            if seen >= self.limit:
                seen = 0
        last = f["q"].max()
        for (q,) in [k for k in self.answered.keys() if k[0] < last - self.memory]:
            self.answered.removeKey((q,))
        self.seen.update((seen,)) if seen else self.seen.clear()
        self.until.update((until,)) if until is not None else self.until.clear()
        yield pd.DataFrame(out, columns=["q", "source", "seen", "promotes", "blocked"]).astype("int64")

    def close(self) -> None:
        pass


def counters(events: DataFrame, limit: int = 4, cooldown: int = 32, memory: int = 1 << 16) -> DataFrame:
    """(q, source, seen, promotes, blocked) of each access in a stream of events (q, source, evicted).

    seen counts a source's accesses from 1 and starts anew after a promotion at `limit`; blocked tells whether the source
    left at most `cooldown` - 1 queries ago.  Rows of one source are to come in the order of q, batch by batch; within a batch any order does.
    State survives a restart with the query's checkpoint.  Null sources are a source.
    """
    keyed = events.select("q", F.col("source"), F.coalesce("evicted", F.lit(False)).alias("evicted")).groupBy("source")
    return keyed.transformWithStateInPandas(statefulProcessor=Counters(limit, cooldown, memory), outputStructType="q long, source long, seen long, promotes long, blocked long", outputMode="Append", timeMode="None")


def run_counters(spark: SparkSession, folder: str, out: str, state: str, **bounds: int) -> None:
    """Takes up the stream of event files (Parquet) in a folder where its checkpoint left it, until nothing new is there."""
    with state_store(spark):
        log = spark.readStream.schema(EVENTS).parquet(folder)
        counters(log, **bounds).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
