"""Streams of arriving files, with batch forms for the same logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pages import side_of

#: The state store that state with timers needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def with_rocksdb(stream: DataFrame) -> DataFrame:
    """The same stream; its session keeps new streams' state in RocksDB from here on."""
    for name, value in ROCKSDB.items():
        stream.sparkSession.conf.set(name, value)
    return stream


class Sides(StatefulProcessor):
    """The clock and the last side of a group; a timer at the end of the clock clears both."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("side", "at long, last string")

    def keep(self, at: int, last: str, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((at, last))
        self.handle.registerTimer(max(at // 1000 + self.minutes * 60_000, watermark) + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.sort_values("at").iloc[-1]
        self.keep(int(newest["at"]), newest["last"], timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, last = self.state.get() if self.state.exists() else (None, "")
        scans = pd.concat(rows).sort_values(["ts", "scan_id"])
        out = []
        for scan, us in zip(scans["scan_id"], microseconds(scans["ts"]), strict=True):
            side, at, last = side_of(us, at, last, self.minutes)
            out.append((*key, scan, side))
        self.keep(at, last, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["person", "doc_type", "day", "scan_id", "side"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class Expiry(StatefulProcessor):
    """The time of a key's open proposal, with a timer at which it expires."""

    def __init__(self, hours: int):
        self.milliseconds = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("proposed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_ = self.state.get()[0] if self.state.exists() else None
        events = pd.concat(rows)
        events = events.assign(us=microseconds(events["ts"]), decided=events["kind"] != "proposed").sort_values(["us", "decided"])
        out = []
        for us, decided in zip(events["us"], events["decided"], strict=True):
            if open_ is not None and us - open_ > self.milliseconds * 1000:  # it had expired before this event
                out.append(self.row(key, open_))
                open_ = None
            open_ = None if decided else us
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_ is None:
            self.state.clear()
        else:
            self.state.update((open_,))
            self.handle.registerTimer(max(open_ // 1000 + self.milliseconds, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "proposed_at", "expired_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            at = self.state.get()[0]
            self.state.clear()
            yield pd.DataFrame([self.row(key, at)], columns=["key", "proposed_at", "expired_at"])

    def row(self, key, at: int) -> tuple:
        return key[0], pd.Timestamp(at, unit="us"), pd.Timestamp(at + self.milliseconds * 1000, unit="us")

    def close(self) -> None:
        pass


def microseconds(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def arrivals(spark: SparkSession, folder: str, *, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream, without their content."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder).select("path", "modificationTime", "length")


def debounced(events: DataFrame, *, gap: str = "5 seconds", watermark: str | None = None) -> DataFrame:
    """Batches (key, ts, file) that end when nothing has come for `gap`. A stream needs a watermark."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("arrivals"), F.max("ts").alias("last"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "arrivals", "last")


def once(events: DataFrame, *, key: str = "sha256", within: str = "1 day") -> DataFrame:
    """Each content once: by watermark on a stream, over all rows in a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
    return events.groupBy(key).agg(F.min(F.struct("ts", *[c for c in events.columns if c not in (key, "ts")])).alias("r")).select(key, "r.*")


def stuck(staged: DataFrame, as_of, *, minutes: int = 30) -> DataFrame:
    """Files that have been staged for longer than `minutes` at as_of."""
    return staged.where(F.col("ts") < as_of - F.expr(f"interval {minutes} minutes"))


def requeued(queue: DataFrame, as_of, *, minutes: int = 30, most: int = 3) -> DataFrame:
    """The queue (file, status, since, attempts, note) after files that were left behind go back: one that has been at work for more
    than `minutes` at as_of is queued again and has one attempt more, after `most` attempts it is dead and says why. Files that wait,
    are done or dead stay as they are; a file that comes late is queued like any other (see merged_arrivals)."""
    left = (F.col("status") == "working") & (F.col("since") < as_of - F.expr(f"interval {minutes} minutes"))
    last = left & (F.col("attempts") >= most)
    return queue.withColumns({
        "status": F.when(last, "dead").when(left, "queued").otherwise(F.col("status")), "since": F.when(left, as_of).otherwise(F.col("since")),
        "attempts": F.col("attempts") + F.when(left & ~last, 1).otherwise(0), "note": F.when(last, F.format_string("given up after %d attempts", "attempts")).otherwise(F.col("note"))})


def merged_arrivals(queue: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The queue with new files (file, ts) of a batch, late or not, each once and queued for its first attempt; files that the queue
    knows already keep their state."""
    new = arrivals.groupBy("file").agg(F.min("ts").alias("since")).join(queue.select("file").hint("merge"), "file", "left_anti")
    return queue.unionByName(new.select("file", F.lit("queued").alias("status"), "since", F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("note")))


def delivery(log: DataFrame, *, most: int = 3) -> DataFrame:
    """Attempts per message (key, ok) and how it ended."""
    out = log.groupBy("key").agg(F.count("*").alias("attempts"), F.max(F.col("ok").cast("int")).alias("ok"))
    return out.select("key", F.least("attempts", F.lit(most)).alias("attempts"), F.when(F.col("ok") == 1, F.when(F.col("attempts") > 1, "retried").otherwise("sent")).when(F.col("attempts") >= most, "failed").otherwise("pending").alias("status"))


def sides_stream(scans: DataFrame, *, minutes: int = 30, within: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """Front and back of scans (person, doc_type, day, scan_id, ts) as they come, with known sides (person, doc_type, day, at, last)
    of an earlier run to begin with: the clock in microseconds and the last side. A group's state goes by a timer of event time
    when the watermark (`within` behind the newest scan) is past the end of its clock. State is in the session's RocksDB store."""
    keys, types = ["person", "doc_type", "day"], dict(scans.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, "scan_id")) + ", side string"
    timed = with_rocksdb(scans).withWatermark("ts", within).groupBy(*keys)
    begin = known.select(*keys, "at", "last").groupBy(*keys) if known is not None else None
    return timed.transformWithStateInPandas(Sides(minutes), schema, "Append", "EventTime", begin)


def expiring(events: DataFrame, *, hours: int = 24, within: str = "1 hour") -> DataFrame:
    """Proposals (key, kind, ts) that nobody decides in time: (key, proposed_at, expired_at), as event time passes. Kind proposed
    starts the clock, again for a new attempt, and every other kind is a decision, which ends it. Of equal times the decision is
    the later one; a decision before any proposal ends nothing. Null keys are one key; rows without a time are left out."""
    types = dict(events.dtypes)
    timed = with_rocksdb(events).where("ts is not null").withWatermark("ts", within).groupBy("key")
    return timed.transformWithStateInPandas(Expiry(hours), f"key {types['key']}, proposed_at timestamp, expired_at timestamp", "Append", "EventTime")


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that has arrived, through `write` per micro-batch, then stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
