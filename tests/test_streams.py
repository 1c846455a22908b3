"""Keyed streams over several batches, stopped and started again, against their batch forms and plain versions."""

import collections
import datetime
import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalens.operators import activity, badges
from catalens.plans import achievements as ach
from catalens.plans import streams
from catalens.streaming import achievements, claims, digests, jobs, keyed, reminders

START = datetime.datetime(2024, 1, 1)
MINUTE = datetime.timedelta(minutes=1)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


class Feed:
    """A folder that grows file by file; each file is a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema

    def add(self, part):
        time.sleep(1.1)  # streams read files by age
        self.spark.createDataFrame(part, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def cut(events, n, rng, disorder):
    """Events in order of time but for a shift of up to `disorder` minutes, in n parts."""
    late = sorted(events, key=lambda e: e[0] + MINUTE * rng.uniform(0, disorder))
    size = -(-len(late) // n)
    return [late[i : i + size] for i in range(0, len(late), size)]


# --- reminders


def plain_reminders(events, handled, until, quiet=60, window=24 * 60):
    """(at, user, kind, source, item, search) in order of time → what a worker that looks all the time would have done by `until`."""
    out, marks, open_, last = set(), {(u, s, i) for u, s, i in handled}, collections.defaultdict(list), {}

    def fire(user, at):
        newest = {}
        for seen, item, search in sorted(open_.pop(user), key=lambda v: (v[0], -v[2])):
            out.add(("processed", user, item, seen, search, at))
            if item is not None and seen >= at - MINUTE * window:
                newest[item] = (seen, search)
        out.update(("item", user, i, seen, search, at) for i, (seen, search) in newest.items() if not any((user, s, i) in marks for s in ("favorite", "review")))
        del last[user]

    for at, user, kind, source, item, search in sorted(events, key=lambda e: e[0]):
        for u in [u for u in last if last[u] + MINUTE * quiet < at or (last[u] + MINUTE * quiet == at and (u, kind) == (user, "view"))]:
            fire(u, last[u] + MINUTE * quiet)
        if kind == "view":
            open_[user].append((at, item, search))
            last[user] = at
        elif kind == "add":
            marks.add((user, source, item))
        else:
            marks.discard((user, source, item))
    for u in [u for u in last if last[u] + MINUTE * quiet <= until]:
        fire(u, last[u] + MINUTE * quiet)
    return out


EVENT = "at timestamp, user_id long, kind string, source string, item long, search_id long"


def test_reminders_over_batches_with_restarts_and_disorder(spark, tmp_path):
    rng = random.Random(8)
    events = []
    for n in range(900):
        at = START + MINUTE * rng.randrange(10 * 24 * 60) + datetime.timedelta(microseconds=n)
        kind = rng.choice(["view", "view", "view", "add", "remove"])
        source = None if kind == "view" else rng.choice(["favorite", "review"])
        events.append((at, rng.randrange(12), kind, source, rng.choice([None, 1, 2, 3]) if kind == "view" else rng.randint(1, 3), n + 2**60 if kind == "view" else None))
    handled = [(u, "favorite", 2) for u in range(0, 12, 3)]
    feed = Feed(spark, tmp_path / "in", EVENT)

    def run():
        kinds = feed.stream()
        views = kinds.filter("kind = 'view'").select("search_id", "user_id", "item", F.col("at").alias("created_at"))
        marks = kinds.filter("kind <> 'view'").select("user_id", "item", "source", F.col("kind").alias("op"), "at", F.xxhash64("at").alias("seq"))
        known = spark.createDataFrame(handled, "user_id long, source string, item long")
        stream = reminders.reminder_stream(views, marks, known, "120 minutes")
        return stream, keyed.run_tagged(stream, str(tmp_path / "job"))

    parts = cut(events, 5, rng, 100)
    for k, part in enumerate(parts):
        feed.add(part)
        if k in (1, 4):  # the job runs, stops and runs again
            stream, out = run()
    got = {(tag, *r) for tag in ("item", "processed") for r in rows(keyed.tagged(stream, out, tag), "user_id", "item", "viewed_at", "search_id", "fired_at")}
    until = max(e[0] for e in events) - 120 * MINUTE
    assert got == {r for r in plain_reminders(events, handled, until) if r[5] <= until}
    assert len({b for b, in rows(keyed.tagged(stream, out, "processed"), "batch")}) >= 4
    notes = reminders.notifications(keyed.tagged(stream, out, "item"))
    assert notes.agg(F.sum("items")).first()[0] == sum(r[0] == "item" for r in got)

    # users who are quiet by then: the batch form, which looks once, processes the same searches
    history = spark.createDataFrame([(e[5], e[1], e[4], e[0], None) for e in events if e[2] == "view"], "search_id long, user_id long, item long, created_at timestamp, notified_at timestamp")
    empty = spark.createDataFrame([], "user_id long, item long")
    processed = activity.reminders(history, empty, empty, F.lit(until))[2]
    quiet = {u for u, in rows(processed, "user_id")}
    assert quiet and rows(processed, "user_id", "search_id") == sorted(((r[1], r[4]) for r in got if r[0] == "processed" and r[1] in quiet), key=str)


def test_a_mark_between_view_and_timer_and_a_view_behind_the_watermark(spark, tmp_path):
    view = lambda minute, user, item, search: (START + MINUTE * minute, user, "view", None, item, search)
    mark = lambda minute, user, kind, item: (START + MINUTE * minute, user, kind, "favorite", item, None)
    feed = Feed(spark, tmp_path / "in", EVENT)
    parts = [
        [view(0, 1, 5, 10), view(1, 1, 6, 11), view(0, 2, 5, 12), mark(0, 3, "add", 7), view(1, 3, 7, 13)],
        [mark(50, 1, "add", 5), mark(61, 2, "add", 5), mark(30, 3, "remove", 7)],  # in time, after user 2's timer, taken back in time
        [view(200, 9, 1, 14)],
        [view(2, 2, 8, 15), view(199, 4, 3, 16), view(500, 9, 1, 17)],  # the first is hours behind the newest
    ]
    for part in parts:
        feed.add(part)

    def fired(delay):
        kinds = feed.stream()
        views = kinds.filter("kind = 'view'").select("search_id", "user_id", "item", F.col("at").alias("created_at"))
        marks = kinds.filter("kind <> 'view'").select("user_id", "item", "source", F.col("kind").alias("op"), "at", F.xxhash64("at").alias("seq"))
        stream = reminders.reminder_stream(views, marks, spark.createDataFrame([], "user_id long, source string, item long"), delay)
        out = keyed.run_tagged(stream, str(tmp_path / delay.replace(" ", "-")))
        return rows(keyed.tagged(stream, out, "item"), "search_id"), rows(keyed.tagged(stream, out, "processed"), "search_id")

    assert fired("5 minutes") == ([(11,), (12,), (13,), (14,), (16,)], [(10,), (11,), (12,), (13,), (14,), (16,)])
    assert (15,) in fired("4 hours")[1]


# --- digests


def test_digests_equal_the_batch_form_at_every_due_time(spark, tmp_path):
    rng = random.Random(3)
    day = 24 * 60
    periods = {a: (0, day, 2 * day, 3 * day)[a % 4] for a in range(8)}
    markers = {a: None if a % 3 == 0 else START - MINUTE * day for a in periods}
    events = [(START + MINUTE * rng.randrange(-day, 11 * day) + datetime.timedelta(microseconds=n), rng.randrange(8), rng.randrange(6), rng.randrange(2), rng.choice([1, -1, 1, None])) for n in range(500)]
    events = [e for e in events if not START + 4 * day * MINUTE < e[0] < START + 8 * day * MINUTE]  # days without any
    shape = "updated_at timestamp, user_id long, reactor long, item long, value long"
    feed = Feed(spark, tmp_path / "in", shape)
    users = spark.createDataFrame([(a, p, markers[a]) for a, p in periods.items()], "user_id long, period_minutes int, notified_at timestamp")

    def run(zeros, folder):
        out = jobs.run_available(digests.digest_stream(feed.stream(), users, START, "120 minutes", zeros=zeros), str(tmp_path / folder))
        return spark.read.schema("user_id long, period_start timestamp, period_end timestamp, reactors long").parquet(out)

    for k, part in enumerate(cut(events, 5, rng, 100)):
        feed.add(part)
        if k in (1, 4):
            got = run(True, "all")
    until = max(e[0] for e in events) - 120 * MINUTE
    expected, marker = [], dict(markers)
    for now in (START + MINUTE * day * k for k in range(11)):  # all periods and markers fall on days
        if now > until:
            break
        standing = {}
        for e in sorted(e for e in events if e[0] <= now):
            standing[e[1:4]] = e
        reactions = spark.createDataFrame([e for e in standing.values() if e[4] is not None], shape)
        table = spark.createDataFrame([(a, periods[a], marker[a]) for a in periods], "user_id long, period_minutes int, notified_at timestamp")
        for r in activity.reaction_digest(table, reactions, F.lit(now)).collect():
            expected.append((r["user_id"], r["period_start"], r["period_end"], r["reactors"]))
            marker[r["user_id"]] = now
    columns = ("user_id", "period_start", "period_end", "reactors")
    assert rows(got, *columns) == sorted(expected, key=str)
    assert any(e[3] == 0 for e in expected) and len({e[2] - e[1] for e in expected}) == 3
    assert rows(run(False, "some"), *columns) == sorted((e for e in expected if e[3]), key=str)


def test_periods_can_change_and_late_reactions_are_left_out(spark, tmp_path):
    at = lambda day, hour=0: START + datetime.timedelta(days=day, hours=hour)
    shape = "updated_at timestamp, user_id long, reactor long, item long, value long, period long"
    feed = Feed(spark, tmp_path / "in", shape)
    for part in (
        [(at(0, 1), 1, 7, 0, 1, None), (at(0, 2), 2, 7, 0, 1, None)],
        [(at(1, 12), 1, None, None, None, 2 * 1440), (at(5), 1, 8, 0, 1, None)],  # from daily to every other day
        [(at(6), 1, 12, 0, 1, None)],
        [(at(0, 3), 1, 9, 0, 1, None), (at(20), 3, 1, 0, 1, None)],  # the first is days behind
    ):
        feed.add(part)
    users = spark.createDataFrame([(1, 1440, START), (2, 0, None)], "user_id long, period_minutes int, notified_at timestamp")
    stream = feed.stream()
    settings = stream.filter("period IS NOT NULL").select("user_id", F.col("period").alias("period_minutes"), F.col("updated_at").alias("at"))
    out = jobs.run_available(digests.digest_stream(stream.filter("period IS NULL"), users, START, "1 hour", settings, default_period=1440, zeros=False), str(tmp_path / "job"))
    got = rows(spark.read.schema("user_id long, period_start timestamp, period_end timestamp, reactors long").parquet(out), "user_id", "period_start", "period_end", "reactors")
    assert got == [(1, at(0), at(1), 1), (1, at(3), at(5), 1), (1, at(5), at(7), 1)]


# --- anonymous searches


def test_claims_and_expiry_equal_the_batch_forms(spark, tmp_path):
    rng = random.Random(9)
    hour = 60 * MINUTE
    shape = "at timestamp, kind string, search_id long, user_id long, anon_id string"
    events = []
    for n in range(400):
        anon = f"a{rng.randrange(25)}"
        at = START + MINUTE * rng.randrange(14 * 24 * 60) + datetime.timedelta(microseconds=n)
        events.append((at, "login", None, n, anon) if rng.random() < 0.15 else (at, "search", n, n if rng.random() < 0.2 else None, anon))
    events = [(a, k, s, u, None if k == "search" and u is not None else x) for a, k, s, u, x in events]
    end = max(e[0] for e in events)
    events += [(end + hour, "login", None, 999, "nobody"), (end + hour, "search", 999, None, "a0")]
    feed = Feed(spark, tmp_path / "in", shape)

    def searches(df):
        return df.filter("kind = 'search'").select("search_id", "user_id", "anon_id", F.col("at").alias("created_at"))

    def logins(df):
        return df.filter("kind = 'login'").select("anon_id", F.col("user_id").alias("login_user"), F.col("at").alias("login_at"))

    for k, part in enumerate(cut(events, 5, rng, 50)):
        feed.add(part)
        if k in (1, 4):
            out = jobs.run_available(claims.claim_and_expire_stream(searches(feed.stream()), logins(feed.stream()), "60 minutes"), str(tmp_path / "job"))
    table = spark.createDataFrame(events, shape)
    written = spark.read.schema("search_id long, login_user long, login_at timestamp").parquet(out)
    settled = claims.settled_history(searches(table), claims.outcomes(written))
    first = {}
    for e in sorted(e for e in events if e[1] == "login"):
        for s in events:
            if s[1] == "search" and s[3] is None and s[4] == e[4] and s[0] <= e[0] <= s[0] + 72 * hour:
                first.setdefault(s[2], e[3])
    watermark = end  # the newest search and login less the delay
    expected = []
    for at, kind, search, user, anon in events:
        if kind == "search":
            claimed = first.get(search)
            if user is not None or claimed is not None or at >= watermark - 72 * hour:
                expected.append((search, user if user is not None else claimed, None if claimed is not None else anon))
    assert rows(settled, "search_id", "user_id", "anon_id") == sorted(expected, key=str)
    assert len(first) > 20 and sum(k == "search" for _, k, *_ in events) > len(expected) > 30

    # with one login for each cookie, H3 then H4 over the whole tables say the same
    one = logins(table).groupBy("anon_id").agg(F.min_by(F.struct("login_user", "login_at"), "login_at").alias("r")).select("anon_id", "r.*")
    out = jobs.run_available(claims.claim_and_expire_stream(searches(feed.stream()), _firsts(feed, spark, one, tmp_path), "60 minutes"), str(tmp_path / "one"))
    written = spark.read.schema("search_id long, login_user long, login_at timestamp").parquet(out)
    got = claims.settled_history(searches(table), claims.outcomes(written))
    batch = activity.expire_anonymous(activity.claim_anonymous(searches(table), one), F.lit(watermark))
    assert rows(got, "search_id", "user_id", "anon_id") == rows(batch, "search_id", "user_id", "anon_id")


def _firsts(feed, spark, one, tmp_path):
    folder = str(tmp_path / "first-logins")
    one.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(one.schema).parquet(folder)


# --- achievements


def test_metrics_follow_taken_back_actions():
    state = {}
    m = achievements.Metrics({}, lambda k: state.get(k, 0), state.__setitem__, badges.BadgeRules())
    got = lambda item, other, value, gone=False: m.got({"item": item, "other": other, "value": value, "gone": gone})
    rng, held = random.Random(1), {}
    for _ in range(2000):
        item, other, value, gone = rng.randrange(4), rng.randrange(6), rng.choice([1, -1]), rng.random() < 0.3
        got(item, other, value, gone)
        held[item, other] = 0 if gone else value
        assert m.values["best_likes"] == max(sum(v == 1 for (i, _), v in held.items() if i == k) for k in range(4))
    days, seen = set(), 0
    base = {"confidence": 0.8, "hour": 12, "weekday": 1, "month": 5, "region": None, "color": "c", "sugar": "", "producer": "p", "sparkling": False, "grapes": [], "rare": False}
    for _ in range(300):
        day = rng.randrange(60)
        m.scan({**base, "item": rng.randrange(30), "day": day})
        days.add(day)
        runs = max(next(n for n in range(1, 99) if d + n not in days) for d in days)
        assert m.values["longest_streak"] == runs
        seen = max(seen, m.values["most_items_in_a_day"])
    assert m.values["regions"] == 0 and m.values["sugars"] == 0 and m.values["same_producer"] == m.values["items"]


class Store:
    """Map and value states of one key that count the trips to them."""

    def __init__(self):
        self.held, self.trips = {}, 0

    def getMapState(self, *_):  # noqa: N802
        return self

    getValueState = getMapState  # noqa: N815

    def get(self):
        return self.getValue("row")

    def update(self, value):
        self.updateValue("row", value)

    def getValue(self, key):  # noqa: N802
        self.trips += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.trips += 1
        self.held[key] = value


def test_names_lie_in_parts_read_and_written_once(monkeypatch):
    monkeypatch.setattr(achievements, "PART_NAMES", 8)
    rng, store, wanted, kept = random.Random(3), Store(), {}, achievements.NOTHING_HELD
    for _ in range(400):
        names, (parts, *_) = achievements.Names(store, *kept), kept
        store.trips, asked = 0, rng.randrange(4)
        for _ in range(asked):
            name, n = f"n{rng.randrange(300)}", rng.randrange(3)
            if rng.random() < 0.5:
                assert names.get(name) == wanted.get(name, 0)
            names.put(name, n)
            wanted[name] = n
        kept = names.flush()
        assert kept[1] == sum(map(bool, wanted.values()))
        assert kept[0] != parts or store.trips <= 2 * asked
    assert kept[0] >= 16
    names = achievements.Names(store, *kept)
    assert {name: names.get(name) for name in wanted} == wanted


def test_a_batch_of_a_user_takes_few_trips_to_the_state_store():
    """However many actions a batch has for a user: what is stored is read and written in bounded parts, not entry by entry."""
    badge = {"code": "liked", "metric": "favorites", "target": 10**6, "meta": False, "hidden": False, "series": None, "pos": 1}
    store, processor, row, held = Store(), achievements.AchievementProcessor([badge], badges.BadgeRules()), Row("user_id", "at_us", "seq", "details"), {}
    processor.init(store)
    for batch, n in enumerate((300, 3000, 2)):
        rng, rows_, store.trips = random.Random(batch), [], 0
        for seq in range(n):
            item, gone = rng.randrange(5000) + 5000 * (n == 2), n > 2 and rng.random() < 0.2
            held[item] = not gone
            rows_.append(row(7, 1000 * batch, seq, json.dumps({"kind": "favorite", "item": item, "gone": gone, "linked": False})))
        rng.shuffle(rows_)
        (said,) = processor.handleInputRows((7,), iter(rows_), None)
        assert said.user_id == 7 and json.loads(said.said)["progress"][-1] == sum(held.values())
        assert store.trips <= 2 + 2 * max(1, len(held) * 2 // achievements.PART_NAMES)


def test_badges_of_each_batch_equal_the_batch_forms(spark, tmp_path):
    """Four batches, with a stop after the second; after each one, states and announcements are those of B1 to B9 over all rows so far."""
    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).cache()
    low, high = events.select(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 4 for k in range(1, 4)]
    feed_dir = str(tmp_path / "in")
    catalogue, items = ach.catalog(spark, d), ach.items(spark, d)
    known = spark.createDataFrame([(0, "scan_5_wines", 2, 2, high, None), (4, "first_scan", None, None, None, low)], "user_id long, code string, progress long, notified_progress long, notified_at timestamp, earned_at timestamp")

    def source(spark_, d_):
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(feed_dir)

    original, streams.event_stream = streams.event_stream, source
    try:
        written = []
        for k, (start, end) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
            part = events.filter((F.lit(start is None) | (F.col("ts") >= F.lit(start))) & (F.lit(end is None) | (F.col("ts") < F.lit(end))))
            time.sleep(1.1)
            part.coalesce(1).write.mode("append").parquet(feed_dir)
            written.append(end)
            if k in (1, 3):
                stream = achievements.achievement_stream(streams.actions(spark, d), catalogue, known, ach.RULES)
                out = keyed.run_tagged(stream, str(tmp_path / "job"), "update")
    finally:
        streams.event_stream = original
    tags = {tag: keyed.tagged(stream, out, tag) for tag in ("state", "earned", "update")}
    batches = sorted({b for b, in rows(tags["state"], "batch")})
    assert len(batches) == 4

    states = known.select("user_id", "code", F.coalesce("progress", F.lit(0)).alias("state_progress"), F.coalesce("notified_progress", F.lit(0)).alias("notified_progress"), "notified_at")
    earned = known.filter("earned_at IS NOT NULL").select("user_id", "code", "earned_at")
    for batch, end in zip(batches, written, strict=True):
        so_far = events if end is None else events.filter(F.col("ts") < F.lit(end))
        before = written[written.index(end) - 1] if written.index(end) else None
        acted = plain_actions(so_far, items)
        recent = acted["all"] if before is None else acted["all"].filter(F.col("ts") >= F.lit(before))
        users = recent.groupBy("user_id").agg(F.max("ts").alias("now"))
        metrics = badges.scan_metrics(acted["scans"], items, ach.RULES).unionByName(badges.social_metrics(acted["reviews"], acted["reactions"], acted["favorites"]))
        standing = badges.with_visibility(badges.progress(users, catalogue, metrics, earned)).join(users, "user_id")
        noted = badges.notify_updates(standing, states, F.col("now")).cache()
        of = lambda tag: tags[tag].filter(F.col("batch") == batch)  # noqa: B023, E731
        said = ("user_id", "kind", "code", "progress", "target")
        assert rows(of("update"), *said) == rows(badges.announcements(noted), *said), batch
        delta = badges.state_delta(noted, F.col("now")).cache()
        kept = ("user_id", "code", "progress", "notified_progress", "notified_at")
        assert rows(of("state"), *kept) == rows(delta, *kept), batch
        fresh = noted.filter("newly_earned").select("user_id", "code", F.col("now").alias("earned_at"))
        assert rows(of("earned"), "user_id", "code", "at") == rows(fresh, "user_id", "code", "earned_at"), batch
        # the tables as a worker would leave them, for the next batch
        changed = {(r["user_id"], r["code"]): r for r in delta.collect()}
        held = {(r["user_id"], r["code"]): tuple(r) for r in states.collect()} | {k: (*k, r["progress"], r["notified_progress"], r["notified_at"]) for k, r in changed.items()}
        states = spark.createDataFrame(list(held.values()), states.schema)
        earned = spark.createDataFrame([tuple(r) for r in earned.unionByName(fresh).collect()], earned.schema)
    current = jobs.current_rows(tags["state"].select("user_id", "code", "progress", "notified_progress", "batch"), ["user_id", "code"])
    mine = {(r["user_id"], r["code"]): (r["state_progress"], r["notified_progress"]) for r in states.collect()}
    assert all(mine[r["user_id"], r["code"]] == (r["progress"], r["notified_progress"]) for r in current.collect())


def plain_actions(events, items):
    """Tables of what the events of streams.actions have come to, and who acted when."""
    c, k = F.col, F.get_json_object("props", "$.k").cast("long")
    newest = lambda kind, *keys: events.filter(c("event_type") == kind).withColumn("item", k).groupBy(*keys).agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select(*keys, "r.*")
    zone = F.when(c("user_id") % 5 == 1, ach.ZONES[1]).when(c("user_id") % 5 == 2, ach.ZONES[2]).when(c("user_id") % 5 == 3, ach.ZONES[3])
    history = events.filter("event_type <> 'error'").select(
        c("event_id").alias("search_id"), "user_id", k.alias("item"), (c("value") / 500 + 0.5).alias("confidence"), c("event_type").isin("view", "purchase").alias("from_camera"), "ts",
        ach.local_time(c("ts"), zone).cast("timestamp_ntz").alias("local_ts"),
    )
    scans = badges.counted_scans(history, items)
    reviews = newest("signup", "user_id", "item").filter("value >= 10").select("user_id", "item", F.when(c("event_id") % 6 != 0, 1 + c("event_id") % 5).alias("rating"), F.when(c("value") >= 100, "text").alias("comment"), F.when(c("item") % 9 == 0, c("item")).alias("notification_id"))
    reactions = newest("error", "user_id", "item").filter("event_id % 13 <> 0").select(c("user_id").alias("reactor"), (c("item") % 15).alias("user_id"), "item", F.when(c("value") >= 200, 1).otherwise(-1).alias("value"))
    favorites = newest("click", "user_id", "item").filter("event_id % 11 <> 0").select("user_id", "item", F.when(c("item") % 4 == 0, c("item")).alias("search_id"))
    acted = scans.select("user_id", "ts").unionByName(events.filter("event_type IN ('signup', 'click', 'error')").select("user_id", "ts")).unionByName(events.filter("event_type = 'error'").select((k % 15).alias("user_id"), "ts"))
    return {"scans": scans, "reviews": reviews, "reactions": reactions, "favorites": favorites, "all": acted}


@pytest.mark.parametrize("name", ["reminder_stream", "digest_stream", "badge_stream", "claim_and_expire_stream"])
def test_streams_of_an_empty_table_and_rerun(spark, tmp_path, name):
    from catalens.plans.registry import QUERIES

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("false")
    for table in ("part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(50).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    source.coalesce(1).write.parquet(str(tmp_path / "folder"))
    file = next((tmp_path / "folder").glob("part-*.parquet"))
    file.rename(tmp_path / "events.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
