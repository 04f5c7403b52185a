"""Streaming scans: access events, deduplication, stream chunks, partial messages, and reloads of signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import signatures as tables


def admitted(events: DataFrame, *, exclude_users: tuple[int, ...] = (), user_col: str = "user_id") -> DataFrame:
    """Access events but for those of excluded users. Works for streams and tables."""
    return events.where(~F.col(user_col).isin(*exclude_users)) if exclude_users else events


def matched(events: DataFrame, signatures: DataFrame, on: str) -> DataFrame:
    """Events whose key a signature table names: a stream-static join."""
    return events.join(F.broadcast(signatures) if signatures.limit(200_001).count() <= 200_000 else signatures, on)


def first_seen(events: DataFrame, *, time_col: str = "ts", keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each key's first event within the watermark: a stream's cache of what was scanned already."""
    if events.isStreaming:
        return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def windowed(events: DataFrame, *, time_col: str = "ts", width: str = "1 hour", by: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """Counts of alerts by tumbling windows of event time; late events are dropped beyond the delay."""
    rows = events.withWatermark(time_col, delay) if events.isStreaming else events
    w = F.window(time_col, width)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


PART = "id string, number int, total int, content binary, ts timestamp"
WHOLE = "id string, content binary, parts int"


def reassembled(parts: DataFrame, *, keep: str = "7 days") -> DataFrame:
    """Whole messages of parts (id, number, total, content, ts): emitted when all are there, forgotten after ``keep``.

    The state of a message is its parts; a repeated number keeps its first content. A part of a wrong number is dropped.
    """
    days = pd.Timedelta(keep)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        numbers, bodies, total = state.get if state.exists else ([], [], 0)
        numbers, bodies, latest = list(numbers), list(bodies), 0
        for b in batches:
            for r in b.sort_values("number").itertuples():
                if r.number not in numbers and 1 <= r.number <= max(r.total, 1):
                    numbers.append(int(r.number))
                    bodies.append(bytes(r.content))
                total = max(total, int(r.total))
                latest = max(latest, int(pd.Timestamp(r.ts).timestamp() * 1000))
        if total and len(numbers) == total:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "content": [b"".join(c for _, c in sorted(zip(numbers, bodies, strict=True)))], "parts": [total]})
        else:
            state.update((numbers, bodies, total))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + int(days.total_seconds() * 1000))

    marked = parts.withWatermark("ts", "1 hour") if parts.isStreaming else parts
    return marked.groupBy("id").applyInPandasWithState(step, WHOLE, "numbers array<int>, bodies array<binary>, total int", "append", GroupStateTimeout.EventTimeTimeout)


def reassembled_batch(parts: DataFrame) -> DataFrame:
    """The same over a table: the parts of each message that are all there, in order."""
    one = parts.where("number between 1 and greatest(total, 1)").groupBy("id", "number").agg(F.min_by("content", "ts").alias("content"), F.max("total").alias("total"))
    held = one.groupBy("id").agg(F.max("total").alias("parts"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("number", "content"))).alias("p")).where("n = parts")
    return held.select("id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("content"), "parts")


def joined_chunks(chunks: DataFrame, *, limit: int = 100 << 20) -> DataFrame:
    """Objects of length-prefixed stream chunks (stream, seq, content); an empty chunk ends one. Beyond ``limit`` bytes a stream is refused."""
    size = F.octet_length("content")
    one = chunks.groupBy("stream").agg(F.sum(size).alias("size"), F.max(F.when(size == 0, F.col("seq"))).alias("end"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    body = F.aggregate(F.filter("c", lambda x: x["seq"] < F.col("end")), F.lit(b""), lambda a, x: F.concat(a, x["content"]))
    return one.where("`end` is not null").select("stream", F.when(F.col("size") <= limit, body).alias("content"), (F.col("size") > limit).alias("refused"))


def watched_tree(events: DataFrame) -> DataFrame:
    """Folders that are watched after a log of (seq, op add or remove, path): the last operation on it or a folder above it counts."""
    from pyspark.sql import Window

    last = events.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("_r = 1").drop("_r")
    p = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))
    tried = last.where("op = 'add'").select("path", F.col("seq").alias("at"), F.explode(above).alias("folder"))
    gone = events.where("op = 'remove'").groupBy(F.col("path").alias("folder")).agg(F.max("seq").alias("gone"))
    killed = tried.join(gone, "folder").where("gone > at").select("path").distinct()
    return last.where("op = 'add'").select("path").join(killed, "path", "left_anti")


class Reloading:
    """A foreachBatch function that scans each micro-batch with signatures, read again when their folder changes."""

    def __init__(self, path: str, scan: Callable[[DataFrame, dict], DataFrame], sink: Callable[[DataFrame, int], None]):
        self.path, self.scan, self.sink = path, scan, sink
        self.state: list | None = None
        self.loaded: dict = {}

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = sorted((r["file"], r["modified"], r["size"]) for r in tables.snapshot(spark, self.path).collect())
        if now != self.state:
            self.state, self.loaded = now, tables.load_folder(spark, self.path)
        self.sink(self.scan(batch, self.loaded), number)


def activity(spark) -> dict[str, int]:
    """How busy the session is: jobs and stages that run, and their tasks by state."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in (tracker.getStageInfo(k) for k in tracker.getActiveStageIds()) if s]
    return {
        "jobs": len(tracker.getActiveJobsIds()), "stages": len(stages), "tasks": sum(s.numTasks for s in stages), "running": sum(s.numActiveTasks for s in stages),
        "done": sum(s.numCompletedTasks for s in stages), "failed": sum(s.numFailedTasks for s in stages),
    }
