"""Streaming forms over arriving result rows (additive: batch results are the same queries)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verdigris.sources import schemas
from verdigris.sources.scratch import exists


def read_arriving(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of Parquet files as they come, with the time they were written."""
    return spark.readStream.schema(schemas.RESULT).parquet(path).withColumn("ts", F.col("_metadata.file_modification_time"))


def once(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each sample once, within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "task_id", "repeat"])


def success_rate(rows: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Success by variant and tumbling window; rows without a verdict do not count. `late` sets the watermark of rows that have none yet."""
    w = (rows.withWatermark("ts", late) if late else rows).groupBy(F.window("ts", width), "variant")
    return w.agg(F.avg(F.col("success").cast("double")).alias("rate"), F.count("success").alias("n")).select(F.col("window.start").alias("start"), "variant", "rate", "n")


def spending(rows: DataFrame, cap: float) -> DataFrame:
    """run_id, spent, calls, over: the running cost of each run, kept as state."""

    def add(key, batches, state):
        spent, calls = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            spent, calls = spent + float(pdf["cost_usd"].fillna(0).sum()), calls + len(pdf)
        state.update((spent, calls))
        yield pd.DataFrame({"run_id": [key[0]], "spent": [spent], "calls": [calls], "over": [spent >= cap]})

    return rows.select("run_id", "cost_usd").groupBy("run_id").applyInPandasWithState(add, "run_id string, spent double, calls long, over boolean", "spent double, calls long", "update", "NoTimeout")


HOUR = 3_600_000
#: What a settled hour is while it is made, and as a table.
SETTLED = "run_id string, hour timestamp, calls long, spent_before double, spent double, refused boolean, batch long"
HOURLY = "run_id string, hour long, calls long, spent_before double, spent double, refused boolean"


class HourlyCap(StatefulProcessor):
    """The spending of a run, settled hour by hour of event time; it starts anew after `idle` hours without a call.

    State of a run: a list of sums of its open hours (an entry for each hour and batch, so calls may come in any order and in any number), what was spent up to the last
    settled hour, and one timer, at the end of the earliest open hour. When the watermark passes it, all hours that are over are settled in order, and the timer goes to the next
    open one, or, where there is none, to the time from which the run would start anew: then it is forgotten. That a run starts anew is decided from event
    time, so results do not depend on how the stream was cut into batches. Each batch costs a run a few accesses to its state.
    """

    def __init__(self, cap: float, idle: int):
        self.cap, self.idle = cap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "hour long, cost double, calls long")
        self.total = handle.getValueState("total", "spent double, last long, timer long")

    def ring(self, old: int | None, new: int) -> None:
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if old != new:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues):
        sums: dict[int, tuple[float, int]] = {}
        for pdf in rows:
            for hour, group in pdf["cost"].fillna(0.0).groupby(pdf["hour"]):
                cost, calls = sums.get(int(hour), (0.0, 0))
                sums[int(hour)] = cost + float(group.sum()), calls + len(group)
        spent, last, timer = self.total.get() if self.total.exists() else (0.0, None, None)
        soonest = min(sums) + HOUR
        ring = soonest if timer is None else min(timer, soonest)
        self.open.appendList([(hour, cost, calls) for hour, (cost, calls) in sums.items()])
        self.ring(timer, ring)
        self.total.update((spent, last, ring))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        spent, last, _ = self.total.get()
        sums: dict[int, tuple[float, int]] = {}
        for hour, cost, calls in self.open.get() if self.open.exists() else ():
            before = sums.get(hour, (0.0, 0))
            sums[hour] = before[0] + cost, before[1] + calls
        over = sorted(hour for hour in sums if hour + HOUR <= now)
        out = []
        for hour in over:
            cost, calls = sums.pop(hour)
            if last is not None and hour - last > self.idle * HOUR:
                spent = 0.0
            out.append((key[0], hour, calls, spent, spent + cost, spent >= self.cap))
            spent, last = spent + cost, hour
        if not sums and not over:
            self.open.clear()
            self.total.clear()
        else:
            if sums:
                self.open.put([(hour, cost, calls) for hour, (cost, calls) in sums.items()])
            else:
                self.open.clear()
            # one hour more than `idle` after the last settled one, a call starts anew whatever is known
            ring = min(sums) + HOUR if sums else last + (self.idle + 1) * HOUR
            if ring > now:
                self.handle.registerTimer(ring)
                self.total.update((spent, last, ring))
            else:
                self.total.clear()
        if out:
            yield pd.DataFrame(out, columns=["run_id", "hour", "calls", "spent_before", "spent", "refused"]).astype({"run_id": object})

    def close(self) -> None:
        pass


def hourly_spending(calls: DataFrame, cap: float, idle: int = 24, late: str = "2 hours") -> DataFrame:
    """run_id, hour, calls, spent_before, spent, refused of a stream of calls (run_id, ts, cost): hours that the watermark has passed. A run that has spent `cap` before an hour is
    refused in it. Calls without a time or a run are left out, those without a cost cost nothing; calls later than `late` may be. Start it within rocksdb()."""
    known = calls.filter("ts is not null and run_id is not null").withWatermark("ts", late)
    rows = known.select(F.col("run_id").cast("string").alias("run_id"), "ts", (F.unix_millis(F.date_trunc("hour", "ts"))).alias("hour"), F.col("cost").cast("double").alias("cost"))
    settled = rows.groupBy("run_id").transformWithStateInPandas(HourlyCap(cap, idle), outputStructType=HOURLY, outputMode="append", timeMode="EventTime")
    return settled.withColumn("hour", F.timestamp_millis("hour"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with timers needs a store that keeps it sorted: streams started within have it."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_once(rows: DataFrame, root: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """Append what a stream has so far to the table `root`, each batch once: a batch that is run again, as after a failure between its write and its commit, replaces its own
    folder. `prepare` is applied to each batch. Returns the ended query; call again with the same checkpoint to go on."""

    def write(batch: DataFrame, number: int) -> None:
        made = prepare(batch).withColumn("batch", F.lit(number))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(root)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def appended(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The table that append_once has written, with `batch`; empty before the first batch."""
    return spark.read.schema(schema).parquet(root) if exists(spark, root) else spark.createDataFrame([], schema)
