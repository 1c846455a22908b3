"""Reminders of viewed items: one keyed stream of views, favourites and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from catalens.operators.activity import REMINDER_QUIET_MINUTES, REMINDER_WINDOW_HOURS
from catalens.streaming.jobs import use_rocksdb
from catalens.streaming.keyed import Cached, InOrder, micros

VIEW, ADD, REMOVE = "view", "add", "remove"


class ReminderProcessor(InOrder):
    """A user's searches that no reminder has handled yet, and the items that are favourites or reviewed.

    Once the user has been quiet long enough, all open searches are processed. Their items of the last hours, each with its latest view, are due for a
    reminder unless they are favourites or reviewed by then.
    """

    EVENT = "kind string, source string, item long, search_id long"
    OUTPUT = "tag string, user_id long, item long, viewed_us long, search_id long, fired_us long"

    def __init__(self, quiet_minutes: int, window_hours: int) -> None:
        self.quiet, self.window = quiet_minutes * 60_000_000, window_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = Cached(handle.getMapState("open", "search_id long", "item long, at long"))
        self.handled = Cached(handle.getMapState("handled", "item long", "sources string"))
        self.quiet_from = handle.getValueState("last", "at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for source, item in initialState[["source", "item"]].itertuples(index=False):
            self.mark(str(source), int(item), True)
        self.handled.flush()

    def mark(self, source: str, item: int, on: bool) -> None:
        held = self.handled.get((item,))
        sources = set(held[0].split(",")) if held else set()
        sources = sources | {source} if on else sources - {source}
        self.handled.put((item,), (",".join(sorted(sources)),) if sources else None)

    def load(self) -> None:
        self.last = self.quiet_from.get()[0] if self.quiet_from.exists() else None
        self.before = self.last

    def save(self) -> None:
        self.open.flush()
        self.handled.flush()
        if self.last != self.before:
            self.quiet_from.clear() if self.last is None else self.quiet_from.update((self.last,))

    def ends(self) -> int | None:
        return None if self.last is None else self.last + self.quiet

    def event(self, user, at, kind, source, item, search_id):
        ends, out = self.ends(), []
        if ends is not None and (ends < at or ends == at and kind == VIEW):
            out = self.fire(user, ends)
        if kind == VIEW:
            self.open.put((search_id,), (item, at))
            self.last = at
        else:
            self.mark(source, item, kind == ADD)
        return out

    def due(self, user, until):
        ends = self.ends()
        return self.fire(user, ends) if ends is not None and ends <= until else []

    def wake(self, waiting):
        ends = self.ends()
        return ends if ends is not None else min((at + self.quiet for at, _, kind, *_ in waiting if kind == VIEW), default=None)

    def fire(self, user, at):
        searches = sorted((k[0], *v) for k, v in self.open.items())
        latest: dict[int, tuple[int, int]] = {}
        for search, item, viewed in searches:  # of equal times the smallest search stays
            self.open.put((search,), None)
            if item is not None and viewed >= at - self.window and (item not in latest or viewed > latest[item][0]):
                latest[item] = (viewed, search)
        self.last = None
        processed = [("processed", user, item, viewed, search, at) for search, item, viewed in searches]
        return processed + [("item", user, item, viewed, search, at) for item, (viewed, search) in latest.items() if self.handled.get((item,)) is None]


def reminder_stream(
    views: DataFrame, marks: DataFrame, handled: DataFrame, delay: str, quiet_minutes: int = REMINDER_QUIET_MINUTES, window_hours: int = REMINDER_WINDOW_HOURS
) -> DataFrame:
    """Views (search_id, user_id, item, created_at) and marks (user_id, item, source, op add or remove, at, seq) → reminders.

    Rows are tagged 'item' (what to remind of) or 'processed' (each search once). `handled` (user_id, source, item) are the marks from before the
    stream. A mark at the very time a reminder fires still counts. Searches without an item keep a session open and are processed with it.
    """
    use_rocksdb(views.sparkSession)
    seen = views.filter("user_id IS NOT NULL").select(
        "user_id", F.col("created_at").cast("timestamp").alias("at"), F.lit(VIEW).alias("kind"), F.lit(None).cast("string").alias("source"), F.col("item").cast("string").alias("item"), F.col("search_id").cast("string").alias("search_id"), F.col("search_id").alias("seq"),
    )
    said = marks.filter("user_id IS NOT NULL AND item IS NOT NULL").select(
        "user_id", F.col("at").cast("timestamp").alias("at"), F.col("op").alias("kind"), "source", F.col("item").cast("string").alias("item"), F.lit(None).cast("string").alias("search_id"), F.xxhash64("seq", "source", "item", "op").alias("seq")
    )
    events = seen.unionByName(said).withColumn("at_us", micros("at")).withWatermark("at", delay)
    fired = events.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=ReminderProcessor(quiet_minutes, window_hours), outputStructType=ReminderProcessor.OUTPUT, outputMode="Append", timeMode="EventTime",
        initialState=handled.select("user_id", "source", "item").groupBy("user_id"),
    )
    return fired.select("tag", "user_id", "item", F.timestamp_micros("viewed_us").alias("viewed_at"), "search_id", F.timestamp_micros("fired_us").alias("fired_at"))


def notifications(items: DataFrame) -> DataFrame:
    """One message per user and firing: number of items and the time they span."""
    return items.groupBy("user_id", "fired_at").agg(F.count(F.lit(1)).alias("items"), F.min("viewed_at").alias("period_start"), F.max("viewed_at").alias("period_end"))
