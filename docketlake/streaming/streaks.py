"""Outage streaks with keyed state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

C = F.col
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def count_streak(at: np.ndarray, bad: np.ndarray, n: int, last: int | None) -> tuple[np.ndarray, np.ndarray, int, int | None]:
    """(at, running count, open count, last): failures in a row over outcomes in any order, carried on from an open count.

    Outcomes at or before `last` have been counted: they are deliveries of old rows and change nothing. Of outcomes at one place, a failure counts.
    """
    if last is not None:
        at, bad = at[at > last], bad[at > last]
    if not len(at):
        return at, at, n, last
    order = np.lexsort((~bad, at))
    at, bad = at[order], bad[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    at, bad = at[first], bad[first]
    place = np.arange(1, len(at) + 1)
    reset = np.maximum.accumulate(np.where(bad, 0, place))
    count = np.where(bad, place - reset + np.where(reset == 0, n, 0), 0)
    return at, count, int(count[-1]), int(at[-1])


class OutageStreaks(StatefulProcessor):
    """Counts failures in a row of one source. The state is the open count, the place of the last outcome and the time of the timer that drops it."""

    def __init__(self, least: int, idle_ms: int):
        self.least, self.idle_ms = least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n bigint, last bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last, timer = self.open.get() if self.open.exists() else (0, None, None)
        at, bad, newest = [], [], 0
        for part in rows:  # 9 bytes an outcome are kept of them
            at.append(part["at"].to_numpy(dtype=np.int64))
            bad.append(part["bad"].to_numpy(dtype=bool))
            newest = max(newest, int(part["time"].max().timestamp() * 1000))
        at, count, n, last = count_streak(np.concatenate(at), np.concatenate(bad), n, last)
        due = max(newest + self.idle_ms, timer or 0)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.open.update((n, last, due))
        hit = count >= self.least
        yield pd.DataFrame({"source": [key[0]] * int(hit.sum()), "at": at[hit], "n": count[hit]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.open.clear()  # rows that old are behind the watermark and do not come back
        yield pd.DataFrame({"source": [], "at": [], "n": []}).astype({"at": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def keyed_streaks(stream: DataFrame, key: str, order: str, failed: str | Column, time: str, least: int = 3, lateness: str = "1 day", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """A stream of (key, at, n) wherever a source has failed at least `least` times in a row; any other outcome resets the count.

    Counts are carried from micro-batch to micro-batch in keyed state, so each batch costs what it brings, and a query that is started again goes on where its
    checkpoint ends. Within a batch rows may stand in any order; from batch to batch places (`order`) ascend, and what comes at or before the last
    counted place of its source is a repeated delivery. A source without outcomes for `idle_ms` of event time after its last one is forgotten.
    The rows of a source in one batch are put in order in one task, at 9 bytes each: bound batches by the source's maxBytesPerTrigger
    or maxFilesPerTrigger. Rows without a time or a place, which have no order, count as nothing; a null failure is none. For one finished table of any size,
    outage_streaks() in loads cuts ranges instead.
    """
    kind = stream.schema[key].dataType
    rows = stream.select(C(key).alias("source"), C(order).cast("long").alias("at"), F.coalesce(C(failed) if isinstance(failed, str) else failed, F.lit(False)).alias("bad"), C(time).cast("timestamp").alias("time")).where("at is not null and time is not null")
    schema = T.StructType([T.StructField("source", kind), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])
    found = rows.withWatermark("time", lateness).groupBy("source").transformWithStateInPandas(statefulProcessor=OutageStreaks(least, idle_ms), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return found.select(C("source").alias(key), "at", C("n").cast("int").alias("n"))


def run_streaks(streaks: DataFrame, root: str) -> DataFrame:
    """Run keyed_streaks() over what is there, or over what has come since, and read all its rows back. Rows, offsets and state are under root."""
    spark = streaks.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # what keyed state with timers needs; a query keeps the setting that it starts with
    try:
        query = streaks.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()
    return spark.read.schema(streaks.schema).parquet(f"{root}/rows")
