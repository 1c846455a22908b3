"""Streaming jobs over the events table, run to completion; results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions.values import local_time
from catalens.operators import logs
from catalens.plans import achievements as ach
from catalens.plans import users as u
from catalens.plans.registry import Tables, query
from catalens.plans.scalars import ZONES
from catalens.session import scratch_path
from catalens.streaming import achievements, claims, digests, jobs, keyed, reminders
from catalens.streaming.jobs import run_available

C = F.col
IN_ORDER = "0 seconds"  # the events table arrives as one file


def event_stream(spark, d):
    schema = Tables(spark, d).events.schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", C("ts").cast("timestamp"))


def item_column():
    return F.get_json_object("props", "$.k").cast("long")


ITEM_OR_NONE = "CASE WHEN k % 17 <> 0 THEN k END"  # some searches find nothing
REMIND = f"""ev AS (SELECT event_id, user_id, event_type, ts, (props->>'k')::BIGINT AS k FROM events), h AS (SELECT event_id, user_id, ts, {ITEM_OR_NONE} AS item FROM ev WHERE event_type IN ('view', 'click')),
   o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM h),
   s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o),
   e AS (SELECT user_id, sid, max(ts) + INTERVAL 60 MINUTE AS fired FROM s GROUP BY ALL HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM ev)),
   p AS (SELECT s.*, fired FROM s JOIN e ON e.user_id = s.user_id AND e.sid = s.sid),
   l AS (SELECT user_id, item, ts, event_id, fired FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sid, item ORDER BY ts DESC, event_id) AS r FROM p WHERE item IS NOT NULL AND ts >= fired - INTERVAL 24 HOUR) WHERE r = 1),
   f AS (SELECT l.event_id, arg_max(m.event_type = 'purchase', m.ts) AS on_list FROM l JOIN ev m ON m.user_id = l.user_id AND m.k = l.item AND m.event_type IN ('purchase', 'error') AND m.ts <= l.fired GROUP BY l.event_id),
   v AS (SELECT DISTINCT l.event_id FROM l JOIN ev m ON m.user_id = l.user_id AND m.k = l.item AND m.event_type = 'signup' AND m.ts <= l.fired)"""


@query(
    "reminder_stream", "X1,H12",
    f"""WITH {REMIND}, {u.FAV} SELECT 'processed' AS tag, user_id, item, ts AS viewed_at, event_id AS search_id, fired AS fired_at FROM p
        UNION ALL SELECT 'item', l.user_id, l.item, ts, l.event_id, fired FROM l LEFT JOIN f USING (event_id) LEFT JOIN fav ON fav.user_id = l.user_id AND fav.item = l.item
        WHERE NOT coalesce(on_list, fav.user_id IS NOT NULL) AND l.event_id NOT IN (SELECT event_id FROM v)""",
)
def _(spark, d):
    kind, k = C("event_type"), item_column()
    views = event_stream(spark, d).filter(kind.isin("view", "click")).select(C("event_id").alias("search_id"), "user_id", F.when(k % 17 != 0, k).alias("item"), C("ts").alias("created_at"))
    marks = event_stream(spark, d).filter(~kind.isin("view", "click")).select(
        "user_id", k.alias("item"), F.when(kind == "signup", "review").otherwise("favorite").alias("source"), F.when(kind == "error", "remove").otherwise("add").alias("op"), C("ts").alias("at"), C("event_id").alias("seq")
    )
    stream = reminders.reminder_stream(views, marks, u.favorites(spark, d).withColumn("source", F.lit("favorite")), IN_ORDER)
    out = keyed.run_tagged(stream, scratch_path(spark, "reminders"))
    rows = [keyed.tagged(stream, out, tag).withColumn("tag", F.lit(tag)) for tag in ("item", "processed")]
    return rows[0].unionByName(rows[1]).select("tag", "user_id", "item", C("viewed_at").cast("timestamp_ntz").alias("viewed_at"), "search_id", C("fired_at").cast("timestamp_ntz").alias("fired_at"))


@query("latest_view_stream", "X2", "SELECT user_id, item, created_at, search_id FROM (SELECT user_id, (props->>'k')::BIGINT AS item, ts AS created_at, event_id AS search_id, row_number() OVER (PARTITION BY user_id, props->>'k' ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def _(spark, d):
    history = event_stream(spark, d).select(C("event_id").alias("search_id"), "user_id", item_column().alias("item"), C("ts").alias("created_at"))
    return jobs.latest_view_stream(history, scratch_path(spark, "latest-views")).select("user_id", "item", C("created_at").cast("timestamp_ntz").alias("created_at"), "search_id")


DIGEST_START = "2024-01-01 06:00:00"
DIGESTED = f"""r AS (SELECT (props->>'k')::BIGINT AS author, user_id AS reactor, event_id % 3 AS item, event_type <> 'error' AS holds, ts FROM events),
   a AS (SELECT author, [720, 1440, 2160, 0][author % 4 + 1] AS p, CASE WHEN author % 3 <> 0 THEN TIMESTAMP '2023-12-31' + INTERVAL 1 HOUR * (author % 5) END AS m FROM (SELECT DISTINCT author FROM r)),
   w AS (SELECT author, coalesce(m, TIMESTAMP '{DIGEST_START}' - INTERVAL 1 MINUTE * p) + INTERVAL 1 MINUTE * p * i AS starts, p FROM a, range(200) t(i) WHERE p > 0),
   n AS (SELECT author, starts, starts + INTERVAL 1 MINUTE * p AS ends FROM w WHERE starts + INTERVAL 1 MINUTE * p <= (SELECT max(ts) FROM r)),
   x AS (SELECT n.author, starts, reactor, item, arg_max(holds, ts) AS holds FROM n JOIN r ON r.author = n.author AND ts > starts AND ts <= ends GROUP BY ALL),
   y AS (SELECT author, starts, count(DISTINCT reactor) AS c FROM x WHERE holds GROUP BY ALL)"""


@query("digest_stream", "X3,H13", f"WITH {DIGESTED} SELECT author AS user_id, starts AS period_start, ends AS period_end, coalesce(c, 0)::BIGINT AS reactors FROM n LEFT JOIN y USING (author, starts)")
def _(spark, d):
    value = F.when(C("event_type") != "error", 1)
    reactions = event_stream(spark, d).select(item_column().alias("user_id"), C("user_id").alias("reactor"), (C("event_id") % 3).alias("item"), value.alias("value"), C("ts").alias("updated_at"), C("event_id").alias("seq"))
    author = C("user_id")
    period = F.element_at(F.array(*[F.lit(p) for p in (720, 1440, 2160, 0)]), (author % 4 + 1).cast("int"))
    marker = F.when(author % 3 != 0, F.lit("2023-12-31").cast("timestamp") + F.make_dt_interval(F.lit(0), (author % 5).cast("int")))
    users = Tables(spark, d).events.select(item_column().alias("user_id")).distinct().select(author, period.alias("period_minutes"), marker.alias("notified_at"))
    out = run_available(digests.digest_stream(reactions, users, DIGEST_START, IN_ORDER), scratch_path(spark, "digests"))
    rows = spark.read.schema("user_id long, period_start timestamp, period_end timestamp, reactors long").parquet(out)
    return rows.withColumns({c: C(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})


STREAM_REV = """rev AS (SELECT user_id, k AS item, CASE WHEN event_id % 6 <> 0 THEN 1 + event_id % 5 END AS rating, CASE WHEN value >= 100 THEN 'text' END AS comment FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE event_type = 'signup') WHERE r = 1 AND value >= 10)"""
STREAM_REA = """rea AS (SELECT user_id AS reactor, k % 15 AS user_id, k AS item, CASE WHEN value >= 200 THEN 1 ELSE -1 END AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE event_type = 'error') WHERE r = 1 AND event_id % 13 <> 0)"""
STREAM_FAV = """fav AS (SELECT user_id, k AS item FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS r FROM ev WHERE event_type = 'click') WHERE r = 1 AND event_id % 11 <> 0)"""
ACTED = f"""ev AS (SELECT *, (props->>'k')::BIGINT AS k FROM events), {ach.SCAN}, {STREAM_REV}, {STREAM_REA}, {STREAM_FAV}, {ach.SOCIAL_METRICS}, {ach.BADGE},
   acts AS (SELECT user_id, created_at AS ts FROM hist JOIN itm USING (item) WHERE user_id IS NOT NULL AND confidence + 0.5 >= 0.7 AND from_camera UNION ALL SELECT user_id, ts FROM ev WHERE event_type IN ('signup', 'click', 'error') UNION ALL SELECT k % 15, ts FROM ev WHERE event_type = 'error'),
   pl AS (SELECT user_id, max(ts) AS now FROM acts GROUP BY user_id), {ach.STANDING},
   sta AS (SELECT user_id, unnest(['scan_25_wines', 'grapes_10', 'regions_7']) AS code, unnest([3, 2, 0]) AS sp, CASE WHEN user_id % 8 = 0 THEN min(ts) ELSE TIMESTAMP '{u.NOW}' END AS na FROM events WHERE user_id % 4 < 2 GROUP BY user_id),
   n0 AS (SELECT g3.*, now, coalesce(sp, 0) AS sp, na, user_id % 4 >= 2 AS first_check FROM g3 JOIN pl USING (user_id) LEFT JOIN sta USING (user_id, code)),
   n1 AS (SELECT *, NOT earned AND visible AND progress > sp AND (sp = 0 OR na IS NULL OR na <= now - INTERVAL 10 MINUTE OR len(list_filter([0.1, 0.25, 0.5, 0.75, 0.9], lambda m: sp / target < m AND progress / target >= m)) > 0) AS moved FROM n0),
   n2 AS MATERIALIZED (SELECT *, moved AND row_number() OVER (PARTITION BY user_id, moved ORDER BY progress / target DESC, pos) <= 2 AS notified FROM n1),
   many AS (SELECT user_id, count_if(newly_earned) AS n, count(*) AS al FROM n2 WHERE first_check GROUP BY user_id HAVING count_if(newly_earned) > 3)"""


def actions(spark, d):
    """The events as what users do: scans, reviews, reactions and favourites, with some taken back."""
    at = {"at": C("ts"), "seq": C("event_id"), "item": item_column()}
    of = lambda kind: event_stream(spark, d).filter(C("event_type") == kind).withColumns(at)
    zone = F.when(C("user_id") % 5 == 1, ZONES[1]).when(C("user_id") % 5 == 2, ZONES[2]).when(C("user_id") % 5 == 3, ZONES[3])
    scans = event_stream(spark, d).filter("event_type <> 'error'").select(
        C("event_id").alias("search_id"), "user_id", item_column().alias("item"), (C("value") / 500 + 0.5).alias("confidence"), C("event_type").isin("view", "purchase").alias("from_camera"),
        C("ts").alias("created_at"), local_time(C("ts"), zone).cast("timestamp_ntz").alias("local_ts"),
    )
    reviews = of("signup").withColumns({"rating": F.when(C("event_id") % 6 != 0, 1 + C("event_id") % 5), "comment": F.when(C("value") >= 100, "text"), "notification_id": F.when(C("item") % 9 == 0, C("item")), "gone": C("value") < 10})
    reactions = of("error").withColumn("reactor", C("user_id")).withColumns({"user_id": C("item") % 15, "value": F.when(C("value") >= 200, 1).otherwise(-1), "gone": C("event_id") % 13 == 0})
    favorites = of("click").withColumns({"search_id": F.when(C("item") % 4 == 0, C("item")), "gone": C("event_id") % 11 == 0})
    stream = achievements.scan_actions(scans, achievements.catalogue_items(ach.items(spark, d)))
    for more in (achievements.review_actions(reviews), achievements.reaction_actions(reactions), achievements.favorite_actions(favorites)):
        stream = stream.unionByName(more)
    return stream


@query(
    "badge_stream", "X4,B8,B9",
    f"""WITH {ACTED} SELECT 'state' AS tag, user_id, code, NULL AS kind, progress::BIGINT AS progress, target, (CASE WHEN notified THEN progress ELSE sp END)::BIGINT AS notified_progress, CASE WHEN notified THEN now ELSE na END AS notified_at FROM n2 WHERE progress <> sp OR notified OR first_check
        UNION ALL SELECT 'earned', user_id, code, NULL, progress::BIGINT, target, NULL, NULL FROM n2 WHERE newly_earned
        UNION ALL SELECT 'update', user_id, code, CASE WHEN newly_earned THEN 'earned' ELSE 'progress' END, progress::BIGINT, target, NULL, NULL FROM n2 WHERE (newly_earned OR (notified AND NOT first_check)) AND user_id NOT IN (SELECT user_id FROM many)
        UNION ALL SELECT 'update', user_id, 'summary', 'summary', n::BIGINT, al, NULL, NULL FROM many""",
)
def _(spark, d):
    known = ach.states(spark, d).withColumnRenamed("state_progress", "progress").join(ach.earned_before(spark, d), ["user_id", "code"], "full")
    stream = achievements.achievement_stream(actions(spark, d), ach.catalog(spark, d), known, ach.RULES)
    out = keyed.run_tagged(stream, scratch_path(spark, "badges"), "update")
    tags = [keyed.tagged(stream, out, tag).withColumn("tag", F.lit(tag)) for tag in ("state", "earned", "update")]
    rows = tags[0].unionByName(tags[1]).unionByName(tags[2]).withColumn("notified_at", C("notified_at").cast("timestamp_ntz"))
    return rows.select("tag", "user_id", "code", "kind", "progress", "target", "notified_progress", "notified_at")


SEARCHED = """hs AS (SELECT event_id AS search_id, CASE WHEN event_type = 'purchase' THEN user_id END AS user_id, CASE WHEN event_type <> 'purchase' THEN 'a' || user_id END AS anon_id, ts AS created_at FROM events WHERE event_type <> 'signup'),
   lg AS (SELECT 'a' || user_id AS anon_id, user_id AS login_user, ts AS login_at FROM events WHERE event_type = 'signup')"""


def searched(e):
    anon = C("event_type") != "purchase"
    return e.filter("event_type <> 'signup'").select(
        C("event_id").alias("search_id"), F.when(~anon, C("user_id")).alias("user_id"), F.when(anon, F.concat(F.lit("a"), C("user_id").cast("string"))).alias("anon_id"), C("ts").alias("created_at")
    )


def claims_written(spark, d):
    logins = event_stream(spark, d).filter("event_type = 'signup'").select(F.concat(F.lit("a"), C("user_id").cast("string")).alias("anon_id"), C("user_id").alias("login_user"), C("ts").alias("login_at"))
    out = run_available(claims.claim_and_expire_stream(searched(event_stream(spark, d)), logins, IN_ORDER), scratch_path(spark, "claims"))
    return spark.read.schema("search_id long, login_user long, login_at timestamp").parquet(out)


@query("claim_stream", "X5,H3", f"WITH {SEARCHED} SELECT search_id, login_user AS user_id, login_at FROM hs JOIN lg ON lg.anon_id = hs.anon_id AND login_at >= created_at AND login_at <= created_at + INTERVAL 72 HOUR")
def _(spark, d):
    return claims_written(spark, d).filter("login_at IS NOT NULL").select("search_id", C("login_user").alias("user_id"), C("login_at").cast("timestamp_ntz").alias("login_at"))


@query(
    "claim_and_expire_stream", "X5,H3,H4",
    f"""WITH {SEARCHED}, wm AS (SELECT least((SELECT max(created_at) FROM hs WHERE user_id IS NULL), (SELECT max(login_at) FROM lg)) AS t),
        m AS (SELECT search_id, arg_min(login_user, login_at) AS login_user FROM hs JOIN lg ON lg.anon_id = hs.anon_id AND login_at >= created_at AND login_at <= created_at + INTERVAL 72 HOUR WHERE user_id IS NULL GROUP BY search_id)
        SELECT search_id, coalesce(user_id, login_user) AS user_id, CASE WHEN login_user IS NULL THEN anon_id END AS anon_id, created_at FROM hs LEFT JOIN m USING (search_id) WHERE user_id IS NOT NULL OR login_user IS NOT NULL OR created_at >= (SELECT t FROM wm) - INTERVAL 72 HOUR""",
)
def _(spark, d):
    history = searched(Tables(spark, d).events).withColumn("created_at", C("created_at").cast("timestamp_ntz"))
    return claims.settled_history(history, claims.outcomes(claims_written(spark, d))).select("search_id", "user_id", "anon_id", "created_at")


@query("change_log_stream", "X6,H1", f"WITH {u.CHANGE_SQL} SELECT user_id, item, coalesce(last_v, value) AS value, coalesce(created_at, f) AS created_at, coalesce(t, created_at) AS updated_at FROM old FULL JOIN fresh USING (user_id, item)")
def _(spark, d):
    raw = event_stream(spark, d)
    changes = raw.select("user_id", item_column().alias("item"), F.when(C("event_type") == "error", "delete").otherwise("put").alias("op"), "value", C("ts").cast("timestamp_ntz").alias("ts"), C("event_id").alias("seq"))
    rows = jobs.change_log_stream(changes, u.state(spark, d), ["user_id", "item"], ["value"], "upsert", scratch_path(spark, "change-log"))
    return rows.withColumns({c: C(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@query(
    "log_metrics_stream", "X7,L2",
    "WITH x AS (SELECT to_timestamp(epoch_us(ts) // 3600000000 * 3600)::TIMESTAMP AS w, CASE WHEN event_type = 'error' THEN 'error' WHEN value * 12 >= 5000 THEN 'warning' ELSE 'info' END AS severity, value * 12 AS ms FROM events) SELECT w AS window_start, severity, count(*) AS requests, round(avg(ms), 4) AS mean_ms FROM x WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events) GROUP BY ALL",
)
def _(spark, d):
    status = F.when(C("event_type") == "error", 500).otherwise(200)
    rows = event_stream(spark, d).select("ts", (C("value") * 12).alias("millis"), logs.severity(status, C("value") * 12, F.lit("GET"), F.lit("/items")).alias("severity"))
    out = jobs.run_available(jobs.log_metrics_stream(rows, "1 hour", "1 minute"), scratch_path(spark, "log-metrics"))
    got = spark.read.parquet(out)
    return got.select(C("window_start").cast("timestamp_ntz").alias("window_start"), "severity", "requests", F.round("mean_ms", 4).alias("mean_ms"))
