"""Achievements as a stream: metrics per user kept up by increments, badges and announcements checked whenever a user has done something.

The state of a user is what the metrics need to grow: which items, attributes and days have been seen, the ends of runs of days, the items of a
day, the current review, reaction or favourite of a pair. Each new event touches a few entries of it, however long the history; entries lie together in
parts of bounded size, each read and written at most once in a batch, as every trip to the state store costs more than the work on an event. Progress, earned badges and
what has been announced are one bounded row per user (one entry per badge). A check sees all rows of a user in a batch; its time is that of
the newest of them, so a replayed batch says the same again. Quiet time after an announcement is measured against it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalens.operators.badges import FIRST_CHECK_LIMIT, HIGH_CONFIDENCE, MAX_UPDATES, MILESTONES, QUIET_MINUTES, RARE_ITEMS, SCAN_CONFIDENCE, BadgeRules
from catalens.session import materialize
from catalens.streaming.jobs import use_rocksdb
from catalens.streaming.keyed import micros

SCAN, REVIEW, GAVE, GOT, FAVORITE = "scan", "review", "gave", "got", "favorite"
#: Columns of the one stream of actions; each kind fills those it needs.
ACTION = (
    "user_id long, kind string, at_us long, seq long, item long, other long, gone boolean, value long, commented boolean, linked boolean, confidence double, day long, hour long, weekday long, month long, "
    "region string, color string, sugar string, producer string, sparkling boolean, grapes array<string>, rare boolean"
)
DETAILS = [c.split()[0] for c in ACTION.split(", ") if not c.startswith(("user_id ", "at_us ", "seq "))]
#: What a check says of a user's badges, one entry of each list per row. A string on its way from Python, opened after the operator.
SAID = "tag string, code string, kind string, progress long, target long, notified_progress long, notified_us long"
SAID_NAMES = [c.split()[0] for c in SAID.split(", ")]
SAID_LISTS = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in SAID.split(", ")))
OUTPUT = "user_id long, at_us long, said string"
PART_NAMES, NOTHING_HELD = 512, (0, 0, "{}")


class Names:
    """Numbers of one user by name. Up to PART_NAMES of them stand in the user's row, more in parts of about that size, read when a name of theirs is asked for.

    A name's part follows from its hash and the number of parts, which doubles as the names grow; `parts` is 0 as long as there are none.
    """

    def __init__(self, state, parts: int, held: int, listed: str) -> None:
        self.state, self.parts, self.held = state, parts, held
        self.known: dict[str, int] = json.loads(listed)
        self.loaded, self.unread, self.changed = len(self.known), set(range(parts)), set()

    def part(self, name: str) -> int:
        return zlib.crc32(name.encode()) % self.parts

    def read(self, part: int) -> None:
        self.unread.remove(part)
        names = json.loads(self.state.getValue((part,))[0])
        self.loaded += len(names)
        self.known.update(names)

    def get(self, name: str) -> int:
        if self.unread and name not in self.known and (part := self.part(name)) in self.unread:
            self.read(part)
        return self.known.get(name, 0)

    def put(self, name: str, n: int) -> None:
        if self.unread:
            self.get(name)  # a part is written whole
        self.known[name] = n
        self.changed.add(name)

    def flush(self) -> tuple[int, int, str]:
        """Writes the parts with a changed name, all of them where their number grows; returns what the user's row keeps."""
        held, parts = self.held - self.loaded + sum(map(bool, self.known.values())), max(self.parts, 1)
        while held > PART_NAMES * parts:
            parts *= 2
        if parts == 1:
            return 0, held, json.dumps({name: n for name, n in self.known.items() if n}, separators=(",", ":"))
        if parts > self.parts:
            for part in list(self.unread):
                self.read(part)
            self.parts, touched = parts, set(range(parts))
        else:
            touched = {self.part(name) for name in self.changed}
        written: dict[int, dict[str, int]] = {part: {} for part in touched}
        for name, n in self.known.items():
            if n and (part := self.part(name)) in written:
                written[part][name] = n
        for part, numbers in written.items():
            self.state.updateValue((part,), (json.dumps(numbers, separators=(",", ":")),))
        return self.parts, held, "{}"


class Metrics:
    """Metrics of one user. `get` and `put` read and write numbers of the user's state by name; a missing one is 0."""

    def __init__(self, values: dict[str, int], get: Callable[[str], int], put: Callable[[str, int], None], rules: BadgeRules) -> None:
        self.values, self.get, self.put, self.rules = values, get, put, rules

    def add(self, metric: str, n: int = 1) -> None:
        self.values[metric] = self.values.get(metric, 0) + n

    def at_least(self, metric: str, n: int) -> None:
        self.values[metric] = max(self.values.get(metric, 0), n)

    def change(self, name: str, by: int) -> int:
        n = self.get(name) + by
        self.put(name, n)
        return n

    def fresh(self, name: str) -> bool:
        """Whether this is seen for the first time."""
        if self.get(name):
            return False
        self.put(name, 1)
        return True

    def scan(self, e: dict) -> None:
        color, month = e["color"], e["month"]
        self.add("high_confidence", e["confidence"] >= HIGH_CONFIDENCE)
        for metric, holds in (
            ("late_night", e["hour"] < 5), ("morning", 6 <= e["hour"] < 10), ("weekend", e["weekday"] >= 5), ("new_year_sparkling", month in (12, 1) and e["sparkling"]),
            ("summer_white", month in (6, 7, 8) and color == self.rules.white), ("autumn_red", month in (9, 10, 11) and color == self.rules.red),
        ):
            self.at_least(metric, int(bool(holds)))
        if self.fresh(f"item:{e['item']}"):
            self.unique_item(e)
        if self.fresh(f"day:{e['day']}:{e['item']}"):
            self.at_least("most_items_in_a_day", self.change(f"items_on:{e['day']}", 1))
        if self.fresh(f"day:{e['day']}"):
            left, right = self.get(f"run_to:{e['day'] - 1}"), self.get(f"run_from:{e['day'] + 1}")
            run = left + 1 + right
            self.put(f"run_to:{e['day'] + right}", run)
            self.put(f"run_from:{e['day'] - left}", run)
            self.at_least("longest_streak", run)

    def unique_item(self, e: dict) -> None:
        self.add("items")
        for one, many in (("region", "regions"), ("color", "colors"), ("sugar", "sugars"), ("producer", "producers")):
            self.add(many, bool(e[one]) and self.fresh(f"{one}:{e[one]}"))
        for attribute in ("region", "color"):
            if e[attribute] is not None:
                self.add(f"{attribute}:{e[attribute]}")
        grapes = [g for g in e["grapes"] or [] if g is not None]
        self.add("sparkling", bool(e["sparkling"]))
        self.add("dry", e["sugar"] == self.rules.dry)
        self.add("sweet", e["sugar"] in self.rules.sweet)
        for code, fragment, _ in self.rules.grapes:
            self.add(f"grape:{code}", any(fragment in g for g in grapes))
        for grape in grapes:
            self.add("grapes", self.fresh(f"grape:{grape}"))
        self.at_least("rare_grape", int(bool(e["rare"])))
        self.at_least("same_producer", self.change(f"by:{e['producer']}", 1))

    def replaced(self, name: str, new: int) -> int:
        """Puts a pair's current value, 0 if it is gone, and returns the one before."""
        old = self.get(name)
        self.put(name, new)
        return old

    def review(self, e: dict) -> None:
        """A review's value packs rating, comment and link to a notification."""
        new = 0 if e["gone"] else 1 + 2 * bool(e["commented"]) + 4 * bool(e["linked"]) + 8 * max(0, e["value"] or 0)
        for packed, by in ((self.replaced(f"review:{e['item']}", new), -1), (new, 1)):
            if packed:
                self.add("comments", by * bool(packed & 2))
                if packed >= 8:
                    held = self.change(f"rated:{packed // 8}", by)
                    self.add("ratings", (by > 0 and held == 1) - (by < 0 and held == 0))
                self.put("linked_reviews", self.get("linked_reviews") + by * bool(packed & 4))
        self.values["five_star"] = int(self.get("rated:5") > 0)
        self.values["review_from_notification"] = int(self.get("linked_reviews") > 0)

    def gave(self, e: dict) -> None:
        new = 0 if e["gone"] else (e["value"] or 0)
        for value, by in ((self.replaced(f"gave:{e['other']}:{e['item']}", new), -1), (new, 1)):
            self.add("likes_given", by * (value == 1))
            self.add("dislikes_given", by * (value == -1))
        self.values["civil"] = min(self.values["likes_given"], 5) + min(self.values["dislikes_given"], 5)

    def got(self, e: dict) -> None:
        """The most likes of one comment: comments are counted by their likes, so the maximum can also fall by one."""
        new = 0 if e["gone"] else (e["value"] or 0)
        old = self.replaced(f"got:{e['item']}:{e['other']}", new)
        step = (new == 1) - (old == 1)
        best = self.values.setdefault("best_likes", 0)
        if step:
            likes = self.change(f"likes:{e['item']}", step)
            self.change(f"with_likes:{likes}", 1)
            left = self.change(f"with_likes:{likes - step}", -1)
            self.values["best_likes"] = likes if likes > best or step < 0 and likes == best - 1 and left == 0 else best

    def favorite(self, e: dict) -> None:
        new = 0 if e["gone"] else 1 + bool(e["linked"])
        old = self.replaced(f"favorite:{e['item']}", new)
        self.add("favorites", bool(new) - bool(old))
        self.put("linked_favorites", self.get("linked_favorites") + (new == 2) - (old == 2))
        self.values["favorite_after_scan"] = int(self.get("linked_favorites") > 0)


def standing(badges: list[dict], values: dict[str, int], earned: set[str]) -> list[dict]:
    """Badges with progress and what is newly earned, visible; badges about badges come last and see what the others give."""
    rows = []
    for b in badges:
        value = min(values.get(b["metric"], 0), b["target"])
        rows.append({**b, "progress": value, "got": not b["meta"] and (b["code"] in earned or value >= b["target"])})
    counts = {"earned": sum(r["got"] for r in rows), "hidden_earned": int(any(r["got"] and r["hidden"] for r in rows))}
    previous: dict[str, bool] = {}
    for r in rows:
        if r["meta"]:
            r["progress"] = min(counts[r["metric"]], r["target"])
        r["new"] = r["code"] not in earned and r["progress"] >= r["target"]
        r["earned"] = r["code"] in earned or r["new"]
        shown = not r["hidden"] if r["series"] is None else previous.get(r["series"], not r["hidden"])
        r["visible"] = r["earned"] or shown
        if r["series"] is not None:
            previous[r["series"]] = r["earned"]
    return rows


def worth_telling(row: dict, state: list, now: int) -> bool:
    """Visible progress that is the first, crosses a milestone or comes after the quiet time."""
    progress, told, told_at = state[:3]
    if row["earned"] or not row["visible"] or row["progress"] <= progress:
        return False
    crossed = any(told / row["target"] < m <= row["progress"] / row["target"] for m in MILESTONES)
    return told == 0 or crossed or told_at is None or told_at <= now - QUIET_MINUTES * 60_000_000


def check(badges: list[dict], values: dict[str, int], states: dict[str, list], now: int, first: bool) -> list[tuple]:
    """Brings `states` (code → progress, announced progress, time of that, time earned) up to date; returns (tag, code, kind, progress, target, …) rows."""
    rows = standing(badges, values, {code for code, s in states.items() if s[3] is not None})
    moved = [r for r in rows if worth_telling(r, states.get(r["code"], [0, 0, None, None]), now)]
    told = {r["code"] for r in sorted(moved, key=lambda r: (-r["progress"] / r["target"], r["pos"]))[:MAX_UPDATES]}
    new, out = [r for r in rows if r["new"]], []
    if first and len(new) > FIRST_CHECK_LIMIT:
        out.append(("update", "summary", "summary", len(new), len(rows), None, None, now))
    else:
        out += [("update", r["code"], "earned", r["progress"], r["target"], None, None, now) for r in new]
    if not first:
        out += [("update", r["code"], "progress", r["progress"], r["target"], None, None, now) for r in rows if r["code"] in told]
    out += [("earned", r["code"], None, r["progress"], r["target"], None, None, now) for r in new]
    for r in rows:
        state = states.setdefault(r["code"], [0, 0, None, None])
        if r["progress"] != state[0] or r["code"] in told or first:
            state[0] = r["progress"]
            state[1:3] = (r["progress"], now) if r["code"] in told else state[1:3]
            out.append(("state", r["code"], None, state[0], r["target"], state[1], state[2], now))
        if r["new"]:
            state[3] = now
    return out


class AchievementProcessor(StatefulProcessor):
    def __init__(self, badges: list[dict], rules: BadgeRules) -> None:
        self.badges, self.rules = badges, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "part int", "names string")
        self.standing = handle.getValueState("standing", "metrics string, states string, parts int, held long, names string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        states = {}
        for b in initialState.known:
            states[b["code"]] = [b["progress"] or 0, b["notified_progress"] or 0, b["notified_us"], b["earned_us"]]
        self.standing.update(("{}", json.dumps(states), *NOTHING_HELD))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.standing.get()
        values, states = map(json.loads, stored[:2] if stored else ("{}", "{}"))
        names = Names(self.seen, *(stored[2:] if stored else NOTHING_HELD))
        metrics, now, blank = Metrics(values, names.get, names.put, self.rules), 0, dict.fromkeys(DETAILS)
        for at, _, details in sorted((at, seq, details) for _, at, seq, details in rows):
            event = {**blank, **json.loads(details)}
            getattr(metrics, event["kind"])(event)
            now = max(now, at)
        out = check(self.badges, values, states, now, stored is None)
        self.standing.update((json.dumps(values), json.dumps(states), *names.flush()))
        if out:
            lists = zip(*(row[: len(SAID_NAMES)] for row in out), strict=True)
            yield Row(user_id=key[0], at_us=now, said=json.dumps(dict(zip(SAID_NAMES, lists, strict=True))))

    def close(self) -> None:
        pass


def catalogue_items(items: DataFrame) -> DataFrame:
    """Items with a flag for grapes that few items have; written once, as every batch of a stream joins them."""
    rare = items.select(F.explode("grapes").alias("grape")).groupBy("grape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE_ITEMS)
    with_rare = items.select("item", F.explode("grapes").alias("grape")).join(rare, "grape").select("item").distinct().withColumn("rare", F.lit(True))
    return materialize(items.join(with_rare, "item", "left").withColumn("rare", F.coalesce("rare", F.lit(False))), "catalogue-items")


def _action(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    given = {"kind": F.lit(kind), "gone": F.lit(False), **columns}
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in ACTION.split(", "))])


def scan_actions(history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Scans (user_id, item, confidence, from_camera, created_at, local_ts, search_id) that count, with the item's attributes."""
    good = history.filter(F.col("user_id").isNotNull() & F.col("item").isNotNull() & (F.col("confidence") >= SCAN_CONFIDENCE) & F.col("from_camera"))
    c, local = F.col, F.col("local_ts")
    return _action(
        good.join(catalogue, "item"), SCAN, user_id=c("user_id"), at_us=micros("created_at"), seq=c("search_id"), item=c("item"), confidence=c("confidence"), day=F.unix_date(F.to_date(local)),
        hour=F.hour(local), weekday=F.weekday(local), month=F.month(local), **{n: c(n) for n in ("region", "color", "sugar", "producer", "sparkling", "grapes", "rare")},
    )


def review_actions(reviews: DataFrame) -> DataFrame:
    """Reviews (user_id, item, rating, comment, notification_id, at, seq, gone): the newest of a pair counts."""
    c = F.col
    return _action(
        reviews, REVIEW, user_id=c("user_id"), at_us=micros("at"), seq=c("seq"), item=c("item"), value=c("rating"), commented=F.coalesce(c("comment") != "", F.lit(False)),
        linked=c("notification_id").isNotNull(), gone=c("gone"),
    )


def reaction_actions(reactions: DataFrame) -> DataFrame:
    """Reactions (reactor, user_id = author, item, value, at, seq, gone), once for who gave and once for who got them."""
    c = F.col
    gave = _action(reactions, GAVE, user_id=c("reactor"), other=c("user_id"), at_us=micros("at"), seq=c("seq"), item=c("item"), value=c("value"), gone=c("gone"))
    return gave.unionByName(_action(reactions, GOT, user_id=c("user_id"), other=c("reactor"), at_us=micros("at"), seq=c("seq"), item=c("item"), value=c("value"), gone=c("gone")))


def favorite_actions(favorites: DataFrame) -> DataFrame:
    """Favourites (user_id, item, search_id, at, seq, gone)."""
    c = F.col
    return _action(favorites, FAVORITE, user_id=c("user_id"), at_us=micros("at"), seq=c("seq"), item=c("item"), linked=c("search_id").isNotNull(), gone=c("gone"))


def achievement_stream(actions: DataFrame, badges: DataFrame, initial: DataFrame, rules: BadgeRules = BadgeRules()) -> DataFrame:
    """Actions of all kinds → rows tagged 'update' (announcements), 'earned' and 'state' (what is known of a badge, newest batch last).

    `badges` is the badge table (a list of bounded length that goes along with the code), `initial` (user_id, code, progress, notified_progress,
    notified_at, earned_at) what is known from before: users with any such row are not new.
    """
    use_rocksdb(actions.sparkSession)
    listed = [r.asDict() for r in badges.orderBy("pos").collect()]
    entry = F.struct("code", "progress", "notified_progress", micros("notified_at").alias("notified_us"), micros("earned_at").alias("earned_us"))
    known = initial.groupBy("user_id").agg(F.collect_list(entry).alias("known"))  # at most one entry per badge
    # a row goes to Python as few values: what an action fills in is one string
    packed = actions.filter("user_id IS NOT NULL").select("user_id", "at_us", "seq", F.to_json(F.struct(*DETAILS)).alias("details"))
    out = packed.groupBy("user_id").transformWithState(
        statefulProcessor=AchievementProcessor(listed, rules), outputStructType=OUTPUT, outputMode="Update", timeMode="None", initialState=known.groupBy("user_id")
    )
    out = out.withColumn("said", F.from_json("said", SAID_LISTS)).select("user_id", "at_us", F.inline(F.arrays_zip(*[F.col(f"said.{c}").alias(c) for c in SAID_NAMES])))
    times = {"notified_at": F.timestamp_micros("notified_us"), "at": F.timestamp_micros("at_us")}
    return out.withColumns(times).drop("notified_us", "at_us")
