"""Structured Streaming: incremental ingest, session memory, activity, windows with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import library
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, build: Callable[[DataFrame], DataFrame], key: str = "source", after: Callable[[], None] | None = None, order: str | None = None, user: str | None = None):
    """Documents (key, text) as they come: unchanged ones are skipped, the chunks of the others replaced.

    Of several versions of a document in one batch the one with the largest ``order`` counts (a
    column such as a version or a time; equal ones by their text), so a batch that is run again
    does the same and, as it finds its hashes in the store, nothing twice. With ``user`` rows carry that user's id and tables
    are written by user and document, as the engine's are. ``after`` is called once chunks have
    changed, to drop vocabularies built on them.
    """
    by = ["user_id", key] if user is not None else [key]

    def batch(new: DataFrame, _: int) -> None:
        newest = F.struct(*([F.col(order)] if order else []), "text")
        latest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), newest).alias("_row")).select(key, "_row.*")
        if user is not None:
            latest = latest.withColumn("user_id", F.lit(user))
        known = store.read("hashes")
        if known is not None and user is not None:
            known = known.filter(F.col("user_id") == user)
        fresh = library.content_hash(latest) if known is None else library.needs_ingest(latest, known, key)
        fresh = fresh.persist()
        try:
            if fresh.take(1):
                built = build(fresh)
                if user is not None and "user_id" not in built.columns:
                    built = built.withColumn("user_id", F.lit(user))
                store.replace("chunks", built, by, also=fresh.select(*by))
                store.replace("hashes", fresh.select(*by, "content_hash"), by)
                if after:
                    after()
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MEMORY_SCHEMA = "session_id long, turns long, summary string, last_document string, expired boolean"


class SessionMemory(StatefulProcessor):
    """The memory of one session: turns, its last words up to ``limit`` characters, the last document cited.

    Two values are kept: the memory, dropped ``idle`` milliseconds of processing time after its
    last message (its end is told by a last row, ``expired``), and the largest seq seen. Messages
    of a batch are taken in order of seq, and one that was seen before isn't taken twice.
    """

    def __init__(self, limit: int, idle: int | None):
        self.limit, self.idle = limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "turns long, summary string, last_document string, due long")
        self.seen = handle.getValueState("seen", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        turns, summary, document, due = self.memory.get() if self.memory.exists() else (0, "", None, None)
        last = self.seen.get()[0] if self.seen.exists() else None
        said = pd.concat(list(rows)).sort_values("seq").drop_duplicates("seq")
        for seq, words, cited in zip(said["seq"], said["text"], said["document"], strict=True):
            if last is not None and seq <= last:
                continue
            turns, last = turns + 1, int(seq)
            summary = f"{summary} {' '.join((words or '').split())}".strip()[-self.limit :]
            document = cited if isinstance(cited, str) else document
        if self.idle is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timers.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(due)
        self.memory.update((turns, summary, document, due))
        if last is not None:
            self.seen.update((last,))
        yield pd.DataFrame([(key[0], turns, summary, document, False)], columns=["session_id", "turns", "summary", "last_document", "expired"])

    def handleExpiredTimer(self, key: Any, timers: Any, expired: Any) -> Iterator[pd.DataFrame]:
        turns, summary, document, _ = self.memory.get()
        self.memory.clear()
        yield pd.DataFrame([(key[0], turns, summary, document, True)], columns=["session_id", "turns", "summary", "last_document", "expired"])

    def close(self) -> None:
        pass


def session_memory(messages: DataFrame, limit: int = 800, idle: int | None = None) -> DataFrame:
    """Rolling memory of each session, a row whenever it changes; needs the state store that keeps several values (RocksDB).

    ``messages``: session_id, seq, text, document (may be null). The state of a session is bounded;
    with ``idle`` (milliseconds) it is dropped once nothing has been said for so long.
    """
    mode = "processingTime" if idle is not None else "none"
    return messages.groupBy("session_id").transformWithStateInPandas(SessionMemory(limit, idle), MEMORY_SCHEMA, "Update", mode)


def last_activity(messages: DataFrame) -> DataFrame:
    """Latest time of each session; for the update mode."""
    return messages.groupBy("session_id").agg(F.max("created_at").alias("last_activity"))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by time window; events later than ``late`` are left out. ``ts`` may come without a time zone."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window: Any = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessionised(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", by: str = "user_id") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
