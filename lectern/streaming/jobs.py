"""Incremental jobs over file streams. Each runs to the end of what is there and can be called again to go on.

What a job has written is found again from its folders (a finished one holds a success mark), so a job that is started anew, on
another driver, goes on where the last one stopped; an epoch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from lectern.session import discard, finished, ship
from lectern.sources.encode import vectorise


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available through ``each`` and wait."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _epoch(name: str) -> int:
    return int(name.rsplit("-", 1)[1])


def snapshot(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The full result of a streaming aggregate, written after each batch; a batch replaces the one before."""
    spark = stream.sparkSession

    def each(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch-{epoch:012d}")
        for old in finished(spark, path):
            if _epoch(old) < epoch:
                discard(spark, f"{path}/{old}")

    run(stream, each, checkpoint, "complete")
    last = finished(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def daily_summary(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counts and durations by day, in event time. In append mode a day comes out once, when the watermark has passed its end."""
    events = events.where(~_tick(events)) if not events.isStreaming else events.withColumns({"event_type": F.when(~_tick(events), F.col("event_type")), "value": F.when(~_tick(events), F.col("value"))})
    whole = F.floor("value").cast("long")
    each = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("event_type").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") != "error").alias("successes"), F.sum(whole).alias("total")
    )
    return each.where("n > 0").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "failures", "successes", "total", F.floor(F.col("total") / F.col("n")).cast("long").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """(user_id, started, ended, n) of runs of events with no longer gap; the end is the last event's time. Ticks only move the watermark."""
    real = F.count_if(~_tick(events))
    each = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return each.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), real.alias("n")).where("n > 0").select("user_id", "started", "ended", "n")


TICK = "_tick"


def _tick(events: DataFrame) -> Column:
    return F.coalesce(F.col(TICK), F.lit(False)) if TICK in events.columns else F.lit(False)


def with_ticks(events: DataFrame, folder: str) -> DataFrame:
    """A stream of events that also reads the times of :func:`tick` from ``folder``."""
    clock = events.sparkSession.readStream.schema(f"ts timestamp, {TICK} boolean").parquet(folder)
    return events.unionByName(clock, allowMissingColumns=True)


def tick(spark: SparkSession, folder: str, ts) -> None:
    """Say that it is ``ts`` now: windows that end before it, less the lateness, are closed by the next run though no later event has come."""
    spark.createDataFrame([(ts, True)], f"ts timestamp, {TICK} boolean").coalesce(1).write.mode("append").parquet(folder)


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the watermark has closed to a Parquet table, each row once (the sink's log makes replays harmless); state keeps open windows only."""
    q = stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def counted_arrivals(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Count what arrives by day, late or not: a few rows a batch, in a folder of the batch."""

    def each(batch: DataFrame, epoch: int) -> None:
        days = batch.where(~_tick(batch)).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
        days.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{epoch:012d}")

    return run(events, each, checkpoint)


def late_rows(spark: SparkSession, closed: str, arrivals: str) -> DataFrame:
    """(day, late): the side table of closed days whose events came, in part, after the day was closed."""
    came = reduce(DataFrame.unionByName, [spark.read.schema("day string, n long").parquet(f"{arrivals}/{x}") for x in finished(spark, arrivals)])
    done = spark.read.parquet(closed).groupBy("day").agg(F.sum("n").alias("counted"))
    every = came.groupBy("day").agg(F.sum("n").alias("came"))
    return every.join(done, "day").where("came > counted").select("day", (F.col("came") - F.col("counted")).alias("late"))


class LastValue(StatefulProcessor):
    """Keyed state of one row: the last (ts, event_id, value), times in microseconds. A null value is kept as a mark, so that an older event doesn't bring a cleared one back.

    The state falls ``lifetime`` seconds after its event, in event time; events older than the watermark never reach it. A key has one timer, set with its
    first event; when it fires too early for a later event it is set again. So an event costs a reading and a writing of the state.
    """

    OUT = "session_id long, response_id string, at long, event_id long, value double"

    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, event_id long, value double")

    def due(self, at: int) -> int:
        return at // 1000 + 1000 * self.lifetime

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = max(rows, key=lambda r: (r.at, r.event_id))
        old = self.last.get()
        if old is not None and (old[0], old[1]) >= (new.at, new.event_id):
            return
        self.last.update((new.at, new.event_id, new.value))
        if old is None:
            self.handle.registerTimer(self.due(new.at))
        yield Row(session_id=key[0], response_id=key[1], at=new.at, event_id=new.event_id, value=new.value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()
        if last is not None and self.due(last[0]) > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(self.due(last[0]))
        else:
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def response_changes(events: DataFrame, lifetime: int = 30 * 86_400, lateness: str = "1 day") -> DataFrame:
    """Changes of the last value of each (session_id, response_id) by (ts, event_id); ``value`` is null where it was cleared.

    Keyed state with timers needs the RocksDB state store, which is set for the session if another is.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = events.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts")).groupBy("session_id", "response_id")
    changes = keyed.transformWithState(statefulProcessor=LastValue(lifetime), outputStructType=LastValue.OUT, outputMode="Update", timeMode="EventTime")
    return changes.select("session_id", "response_id", F.timestamp_micros("at").alias("ts"), "event_id", "value")


def response_state(events: DataFrame, path: str, checkpoint: str, lifetime: int = 30 * 86_400, lateness: str = "1 day") -> StreamingQuery:
    """Run the changes into an upserted table below ``path``; a batch writes its changed keys only. Read it with :func:`responses`."""
    target = responses_table(events.sparkSession, path)
    return run(response_changes(events, lifetime, lateness), target.take, checkpoint, "update")


def responses_table(spark: SparkSession, path: str) -> UpsertedTable:
    return UpsertedTable(spark, path, ["session_id", "response_id"], ["ts", "event_id"])


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, response_id, value) of the values that aren't cleared."""
    rows = responses_table(spark, path).read()
    rows = spark.createDataFrame([], "session_id long, response_id string, value double") if rows is None else rows
    return rows.where("value IS NOT NULL").select("session_id", "response_id", "value")


class UpsertedTable:
    """A Parquet table that batches are upserted into: a base and one delta a batch, merged when read.

    A batch writes its own rows only; every ``compact_every`` batches a new base is written. Nothing is overwritten
    while it is read.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | list[str], order: str | list[str], compact_every: int = 10):
        self.spark, self.path, self.compact_every = spark, path, compact_every
        self.key, self.order = ([x] if isinstance(x, str) else x for x in (key, order))

    def parts(self) -> list[str]:
        """The newest base, if there is one, and the deltas after it."""
        found = finished(self.spark, self.path)
        bases, deltas = ([x for x in found if x.startswith(kind)] for kind in ("base", "delta"))
        since = _epoch(bases[-1]) if bases else -1
        return bases[-1:] + [x for x in deltas if _epoch(x) > since]

    def read(self) -> DataFrame | None:
        """Of each key the row of its latest batch, and in that the one of the highest order; None before any batch."""
        parts = self.parts()
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{x}").withColumn("_epoch", F.lit(_epoch(x))) for x in parts])
        return self._last(rows, F.desc("_epoch"), *map(F.desc, self.order)).drop("_epoch")

    def _last(self, rows: DataFrame, *order: Column) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*self.key).orderBy(*order))).where("_n = 1").drop("_n")

    def take(self, batch: DataFrame, epoch: int) -> None:
        if any(_epoch(x) >= epoch for x in self.parts()):
            return  # a replay
        self._last(batch, *map(F.desc, self.order)).write.mode("overwrite").parquet(f"{self.path}/delta-{epoch:012d}")
        parts = self.parts()
        if len(parts) > self.compact_every:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base-{epoch:012d}")
            for old in parts:
                discard(self.spark, f"{self.path}/{old}")


def vectorise_backlog(stream: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Encode new rows as they come; the stream's checkpoint is the record of what is done."""

    def each(batch: DataFrame, epoch: int) -> None:
        vectorise(batch, None, key).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return run(stream, each, checkpoint)
