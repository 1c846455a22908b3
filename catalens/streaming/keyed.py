"""Keyed processors that see the events of a key in order of time, and streams with several outputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalens.streaming.jobs import run_available


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def plain(value):
    """A value of a pandas row as the state store takes it."""
    if value is None or pd.isna(value):
        return None
    return value.item() if hasattr(value, "item") else value


def frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    """Rows of long and string columns; numbers stay whole where some are null."""
    columns = [c.split() for c in ddl.split(", ")]
    out = pd.DataFrame(rows, columns=[c[0] for c in columns], dtype=object)
    return out.astype({name: "Int64" for name, kind in columns if kind == "long"})


class Cached:
    """A map state whose entries are read once and written once in a call, however often they change."""

    def __init__(self, state) -> None:
        self.state, self.known, self.changed = state, {}, set()

    def get(self, key: tuple) -> tuple | None:
        if key not in self.known:
            self.known[key] = tuple(self.state.getValue(key)) if self.state.containsKey(key) else None
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """None forgets the entry."""
        self.known[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple[tuple, tuple]]:
        stored = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        return [(k, v) for k, v in ({**stored, **self.known}).items() if v is not None]

    def flush(self) -> None:
        for key in self.changed:
            if self.known[key] is not None:
                self.state.updateValue(key, self.known[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.known, self.changed = {}, set()


class InOrder(StatefulProcessor):
    """Holds events back until the watermark has passed them, then hands them over by (time, number).

    So results do not depend on how the stream is cut into batches or on disorder within the watermark's delay. Input rows have
    the columns at_us and seq (a number that tells events of one time apart) besides those of EVENT, whole numbers as strings: pandas would make floats
    of those that are null in some rows. A subclass says what an event does, what is due when the watermark stands at a time, and when it wants to be
    woken next; `load` and `save` stand around each round. Times are microseconds.
    """

    EVENT = ""
    OUTPUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns, kinds = zip(*(c.split() for c in self.EVENT.split(", ")), strict=True)
        self.whole = [k == "long" for k in kinds]
        self.waiting = handle.getListState("waiting", f"at long, seq long, {self.EVENT}")

    def load(self) -> None:
        pass

    def save(self) -> None:
        pass

    def event(self, key, at: int, *values) -> list[tuple]:
        raise NotImplementedError

    def due(self, key, until: int) -> list[tuple]:
        raise NotImplementedError

    def wake(self, waiting: list[tuple]) -> int | None:
        """When to be woken, given the events that wait, (time, number, *values) each."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows:
            for at, seq, *values in batch[["at_us", "seq", *self.columns]].itertuples(index=False):
                held = [plain(v) for v in values]
                fresh.append((int(at), int(seq), *[int(v) if w and v is not None else v for v, w in zip(held, self.whole, strict=True)]))
        yield from self.advance(key, timerValues, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues, [])

    def advance(self, key, timerValues, fresh: list[tuple]) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        until, out = watermark * 1000, []
        held = sorted([*(tuple(x) for x in self.waiting.get()), *fresh], key=lambda x: x[:2])
        ready = sum(x[0] <= until for x in held)
        later = held[ready:]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        elif fresh:
            self.waiting.appendList(fresh)
        self.load()
        for at, _, *values in held[:ready]:
            out += self.event(key[0], at, *values)
        out += self.due(key[0], until)
        wake = self.wake(later)
        self.save()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wake is not None:
            self.handle.registerTimer(max(-(-wake // 1000), watermark + 1))
        if out:
            yield frame(out, self.OUTPUT)

    def close(self) -> None:
        pass


def run_tagged(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Writes each batch once, split by its column `tag`, to <folder>/out/batch=N/tag=T. A replayed batch overwrites its own rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("tag").parquet(f"{folder}/out/batch={batch_id}")

    return run_available(stream, folder, step, mode)


def tagged(like: DataFrame, out: str, tag: str) -> DataFrame:
    """All rows of one output, with the batch they came in; `like` is the stream that wrote them."""
    fields = [f for f in like.schema.fields if f.name != "tag"]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "batch long", "tag string"])
    return like.sparkSession.read.schema(schema).parquet(out).filter(F.col("tag") == tag).drop("tag")
