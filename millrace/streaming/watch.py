"""A stream of file events that keeps the tables fresh."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..constants import DEBOUNCE_MS, WATCHED_EXTENSIONS
from ..operators import changes as ch
from ..schema import EVENTS
from ..session import Index
from ..sources import tree
from ..sources.ignore import tree_rules, without_ignored
from ..sources.store import materialized
from ..sources.tree import extension

NAME = "millrace-watch"


def watched(events: DataFrame) -> DataFrame:
    """Events of files that matter; a file that goes matters whatever its extension."""
    return events.where(~F.col("path").contains("node_modules") & (F.lower(extension(F.col("path"))).isin(WATCHED_EXTENSIONS) | (F.col("event") == "unlink")))


def debounced(events: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(path, event, ts, n): the last event of each run of events of a file without a pause longer than the gap.

    As a stream this needs a watermark, and the last run of a file waits for
    later events; ``settled`` does not.
    """
    runs = events.groupBy("path", F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
    return runs.agg(F.max_by("event", "ts").alias("event"), F.max("ts").alias("ts"), F.count("*").alias("n")).drop("w")


class _Settling(StatefulProcessor):
    """Holds a file's last event until there have been no more of them for a while."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "event string, ts timestamp, n long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, best = 0, None
        if self.held.exists():
            event, ts, n, due = self.held.get()
            best = (pd.Timestamp(ts), event)
            self.handle.deleteTimer(due)
        for batch in rows:
            n += len(batch)
            last = max(zip(batch["ts"], batch["event"]))
            best = last if best is None or last > best else best
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.held.update((best[1], best[0].to_pydatetime(), n, due))
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            event, ts, n, _ = self.held.get()
            self.held.clear()
            yield pd.DataFrame({"path": [key[0]], "event": [event], "ts": [pd.Timestamp(ts)], "n": [n]})

    def close(self) -> None:
        pass


def settled(events: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(path, event, ts, n) of a stream of events: a file's last event, once ``gap_ms`` have passed on the clock without another one.

    Each event puts off the timer of its file, so a run comes out after its
    last event whether or not others follow.  The session's state store must be one that has timers.
    """
    keyed = events.where("path is not null and event is not null and ts is not null").select("path", "event", "ts").groupBy("path")
    return keyed.transformWithStateInPandas(_Settling(gap_ms), "path string, event string, ts timestamp, n long", "Append", "ProcessingTime")


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path: what a batch has to do, each file once."""
    return events.groupBy("path").agg(F.max_by("event", F.struct("ts", "event")).alias("event"), F.max("ts").alias("ts"))


def applied(index: Index, batch: DataFrame, report: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """Brings ``index`` up to date with a batch of events, and reports symbols that changed and files that depend on theirs.

    Only the files that the batch names are read.  A file that is not there any
    more goes, whatever its last event says.
    """
    last = materialized(last_events(watched(batch)), "events")
    if last.isEmpty():
        return
    scanned = materialized(index.scan(last.where("event <> 'unlink'").select("path")), "scanned")
    gone = last.join(scanned, "path", "left_anti").select("path")
    gone = materialized(gone.join(index.table("files"), "path", "left_semi"), "gone")
    if not gone.isEmpty():
        index.remove(gone)
    if scanned.isEmpty():
        return
    kept = scanned.select("path")
    before = materialized(index.table("symbols").join(kept, "path", "left_semi"), "symbols") if report else None
    index.refresh(scanned, partial=True)
    if report:
        after = index.table("symbols").join(kept, "path", "left_semi")
        diff = ch.symbol_diff(before, after)
        report(diff, index.table("edges").join(kept.withColumnRenamed("path", "dst"), "dst", "left_semi").select("dst", "src").distinct())


def start(index: Index, events_folder: str, checkpoint: str, report: Callable[[DataFrame, DataFrame], None] | None = None, once: bool = False, gap_ms: int | None = DEBOUNCE_MS) -> StreamingQuery:
    """Follows a folder of event rows (path, event, ts); there is one watcher in a session.

    A file's events are taken together until there have been none for
    ``gap_ms`` on the clock.  Without a gap, or ``once``, every batch takes what there is.
    """
    for q in index.spark.streams.active:
        if q.name == NAME:
            return q
    stream = index.spark.readStream.schema(EVENTS).json(events_folder)
    timed = gap_ms is not None and not once
    if timed:
        stream = settled(watched(stream), gap_ms).drop("n")
    writer = stream.writeStream.queryName(NAME).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: applied(index, df, report))
    with _state_store(index.spark, TIMER_STORE if timed else None):
        return (writer.trigger(availableNow=True) if once else writer.outputMode("append")).start()


#: The state store that has timers.
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """The session's state store while a query starts, which keeps it; others started later are not concerned."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        if provider and before is None:
            spark.conf.unset(key)
        elif provider:
            spark.conf.set(key, before)


def drained(query: StreamingQuery, patience: float = 120.0) -> None:
    """Waits until a running query has taken all events and holds none back."""
    until, idle = time.monotonic() + patience, 0
    seen = None
    while idle < 3 and query.isActive:  # the first may be over, the second may have begun before the last event
        p = query.lastProgress
        if p is not None and p["batchId"] != seen:
            seen = p["batchId"]
            states = p["stateOperators"]
            idle = idle + 1 if not p["numInputRows"] and not sum(x["numRowsTotal"] for x in states) else 0
        if time.monotonic() > until:
            raise TimeoutError("the watcher does not come to rest")
        time.sleep(0.05)
    if query.exception() is not None:
        raise query.exception()


def events_of(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """The events (path, event, ts) that a scan means for the stored files."""
    kind = F.when(F.col("status") == "removed", "unlink").when(F.col("status") == "new", "add").otherwise("change")
    return ch.changes(scanned, stored).where(~F.col("status").isin("unchanged", "retry")).select("path", kind.alias("event"), F.current_timestamp().alias("ts"))


def poll(index: Index, events_folder: str, seen: DataFrame) -> DataFrame:
    """Writes the events since the scan ``seen`` to the folder that ``start`` follows; returns the scan to go on from.

    A scan here is (path, content_hash) by size and time of change, so that
    contents are not read to find out that nothing happened.
    """
    now = materialized(polled(index), "polled")
    events = events_of(now, seen.withColumn("stale", F.lit(False)).withColumn("summary", F.lit("-")))
    if not events.isEmpty():
        events.write.mode("append").json(events_folder)
    return now


def polled(index: Index) -> DataFrame:
    """(path, content_hash) of the tree's files, where the hash is of their size and time of change."""
    files = tree.guarded(tree.listed(index.spark, index.root), excludes=tree.excluded_globs(ignore_lines=tree.ignore_lines(index.spark, index.root)))
    files = without_ignored(files, tree_rules(index.spark, index.root))
    return files.select("path", F.concat_ws("-", "length", F.unix_micros("modified")).alias("content_hash"))
