"""Watching for saved files: events are classified, gathered by pauses and applied as micro-batches.

The stream keeps what was saved since the last pause, path by path, and a timer for each watched tree; both are in its checkpoint,
so a burst outlasts a restart. All other state lies in the stored graph and its file hashes: a batch compares hashes,
so events that change nothing do nothing, and a batch that is run again gives the same graph.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

QUIET = "400 milliseconds"
QUIET_MS = 400
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# What a change of a file means.
IGNORED_SEGMENTS = ("bin", "obj", ".git", ".vs", "node_modules")
STRUCTURAL_EXTENSIONS = (".csproj", ".sln", ".slnx", ".props", ".targets")
STRUCTURAL_NAMES = ("global.json",)


def verdict(path: Column, store: str | None = None) -> Column:
    """Ignore, Content or Structural; store: the path of the stored graph, whose own files are ignored."""
    lower = F.lower(F.translate(path, "\\", "/"))
    name = F.regexp_extract(lower, r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    ignored = F.arrays_overlap(F.split(lower, "/"), F.array(*[F.lit(s) for s in IGNORED_SEGMENTS]))
    if store:
        ignored = ignored | lower.startswith(store.replace("\\", "/").lower())
    return F.when(ignored, "Ignore").when(extension == ".cs", "Content").when(extension.isin(*STRUCTURAL_EXTENSIONS) | name.isin(*STRUCTURAL_NAMES), "Structural").otherwise("Ignore")


def debounced(events: DataFrame, keys: list[str], quiet: str = QUIET, watermark: str | None = None) -> DataFrame:
    """Events (ts, path and keys) gathered until a pause: first, last and distinct paths of each burst.

    Works on tables and on streams; a stream needs a watermark.
    """
    events = events.withWatermark("ts", watermark) if watermark else events
    bursts = events.groupBy(*keys, F.session_window("ts", quiet).alias("w"))
    return bursts.agg(F.array_sort(F.collect_set(F.lower("path"))).alias("paths"), F.count("*").alias("events")).select(*keys, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "paths", "events")


class Burst(StatefulProcessor):
    """Gathers the paths of a key until no event has come for `quiet` milliseconds, then gives them and forgets them.

    A path is an entry of a map in the state store, so memory doesn't grow with a burst. Each event puts the timer off.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "name string", "path string, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.dropna(subset=["path"])
            for name, own in part.groupby(part["path"].str.lower())["path"]:
                before = self.paths.getValue((name,)) if self.paths.containsKey((name,)) else None
                spelled = min(own) if before is None else min(before[0], min(own))
                self.paths.updateValue((name,), (spelled, len(own) + (before[1] if before else 0)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for _, (path, events) in self.paths.iterator():
            yield pd.DataFrame({"watched": [key[0]], "path": [path], "events": [events]})
        self.paths.clear()

    def close(self) -> None:
        pass


def bursts(events: DataFrame, quiet: int = QUIET_MS) -> DataFrame:
    """A stream of events (watched, path) as (watched, path, events): each path of a burst once, when its key has been quiet for so many milliseconds.

    watched names the tree that is watched, each with a timer of its own. Events without a path only put the pause off. The
    session's state store becomes the one that keeps maps and timers.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = events.select(F.col("watched").cast("string").alias("watched"), F.col("path").cast("string").alias("path")).groupBy("watched")
    return keyed.transformWithStateInPandas(Burst(quiet), "watched string, path string, events long", "append", "processingTime")


def watch(events: DataFrame, apply: Callable[[DataFrame, bool], None], checkpoint: str, store: str | None = None, once: bool = False, quiet: int = QUIET_MS) -> StreamingQuery:
    """Run apply(paths, structural) for each burst of a stream with a column path that holds a change; once: for what is there now, without waiting for a pause.

    A batch that fails is logged, and watching goes on.
    """

    def batch(df: DataFrame, number: int) -> None:
        try:
            seen = df.select(F.col("path"), verdict(F.col("path"), store).alias("verdict")).filter("verdict <> 'Ignore'").groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path"), F.max("verdict").alias("verdict")).drop("key")
            structural = bool(seen.filter("verdict = 'Structural'").take(1))
            if structural or seen.take(1):
                apply(seen.select("path"), structural)
        except Exception:
            logging.getLogger(__name__).exception("batch %s failed; still watching", number)

    if not once:
        kept = events.filter(verdict(F.col("path"), store) != "Ignore")
        events = bursts(kept.select(F.lit(store or "").alias("watched"), "path"), quiet)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, quiet // 4)} milliseconds")
    return writer.start()
