"""Digests of reactions: chained timers per author, each with a period and a marker of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from catalens.streaming.jobs import use_rocksdb
from catalens.streaming.keyed import Cached, InOrder, micros

MINUTE = 60_000_000


class DigestProcessor(InOrder):
    """Reactions in force since an author's marker; a digest every period counts their authors and moves the marker.

    A digest covers (marker, marker + period]. What it has counted is forgotten, so the state holds one period. Without reactions and with
    `zeros` off no timer runs: the marker is moved by whole periods when the next event comes.
    """

    EVENT = "reactor long, item long, value long, period long"
    OUTPUT = "user_id long, start_us long, end_us long, reactors long"

    def __init__(self, start_us: int, default_period: int, zeros: bool) -> None:
        self.start, self.default, self.zeros = start_us, default_period, zeros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.author = handle.getValueState("author", "period long, marker long")
        self.marks = Cached(handle.getMapState("marks", "reactor long, item long", "at long"))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        period, marker = initialState[["period_minutes", "marker_us"]].iloc[0]
        self.load()
        self.begin(int(period or 0), None if marker is None or marker != marker else int(marker))
        wake = self.wake([])
        self.save()
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def load(self) -> None:
        self.now = tuple(self.author.get()) if self.author.exists() else None
        self.before, self.counting = self.now, None

    def save(self) -> None:
        self.marks.flush()
        if self.now != self.before:
            self.author.update(self.now)

    def held(self) -> dict[tuple, int]:
        """Reactions in force, by (reactor, item)."""
        if self.counting is None:
            self.counting = {k: v[0] for k, v in self.marks.items()}
        return self.counting

    def begin(self, period: int, marker: int | None) -> None:
        """An author who never had a digest gets the first one at the start of the stream."""
        self.now = (period * MINUTE, self.start - period * MINUTE if marker is None else marker)

    def event(self, author, at, reactor, item, value, period):
        if self.now is None:
            self.begin(self.default, None)
        out = self.digests(author, at - 1)
        if period is not None:
            self.now = (period * MINUTE, self.now[1])
        elif value:
            self.held()[reactor, item] = at
            self.marks.put((reactor, item), (at,))
        elif self.held().pop((reactor, item), None) is not None:
            self.marks.put((reactor, item), None)
        return out

    def due(self, author, until):
        return self.digests(author, until) if self.now is not None else []

    def wake(self, waiting):
        if self.now is None:
            return min((at for at, *_ in waiting), default=None)
        period, marker = self.now
        return marker + period if period > 0 and (self.zeros or waiting or self.held()) else None

    def digests(self, author, until):
        """All digests whose end is not after `until`."""
        period, marker = self.now
        out = []
        while period > 0 and marker + period <= until:
            if not self.held() and not self.zeros:
                marker += (until - marker) // period * period
                break
            end = marker + period
            counted = [k for k, at in self.held().items() if at <= end]
            reactors = len({k[0] for k in counted if marker < self.held()[k]})
            for k in counted:
                del self.held()[k]
                self.marks.put(k, None)
            if reactors or self.zeros:
                out.append((author, marker, end, reactors))
            marker = end
        self.now = (period, marker)
        return out


def digest_stream(reactions: DataFrame, users: DataFrame, start, delay: str, periods: DataFrame | None = None, default_period: int = 0, zeros: bool = True) -> DataFrame:
    """Reactions (user_id = author, reactor, item, value, updated_at) → (user_id, period_start, period_end, reactors).

    `users`: (user_id, period_minutes, notified_at); a period of 0 means no digests, a null notified_at a first digest at `start`. Other authors get
    `default_period`. A null or 0 value takes the reaction back. `periods`: (user_id, period_minutes, at) are later changes of the setting, a stream
    too. Digests without reactors are rows as well unless `zeros` is off; their marker moves either way.
    """
    spark = reactions.sparkSession
    use_rocksdb(spark)
    start_us = spark.range(1).select(micros(F.lit(start) if not isinstance(start, Column) else start)).first()[0]
    null, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string").alias(c)
    seq = F.col("seq") if "seq" in reactions.columns else F.xxhash64("reactor", "item", "value")
    events = reactions.select("user_id", F.col("updated_at").cast("timestamp").alias("at"), text("reactor"), text("item"), text("value"), null.alias("period"), seq.alias("seq"))
    if periods is not None:
        setting = F.col("period_minutes").cast("string").alias("period")
        changed = periods.select("user_id", F.col("at").cast("timestamp").alias("at"), *[null.alias(c) for c in ("reactor", "item", "value")], setting, F.xxhash64("period_minutes").alias("seq"))
        events = events.unionByName(changed)
    known = users.select("user_id", F.col("period_minutes").cast("long").alias("period_minutes"), micros("notified_at").alias("marker_us"))
    out = events.withColumn("at_us", micros("at")).withWatermark("at", delay).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=DigestProcessor(start_us, default_period, zeros), outputStructType=DigestProcessor.OUTPUT, outputMode="Append", timeMode="EventTime", initialState=known.groupBy("user_id")
    )
    return out.select("user_id", F.timestamp_micros("start_us").alias("period_start"), F.timestamp_micros("end_us").alias("period_end"), "reactors")
