"""User activity: events as search history, orders and line items as favourites, reviews and reactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.operators import activity as h
from catalens.plans.registry import Tables, query

C = F.col
NOW = "2024-01-29 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def history(spark, d):
    e = Tables(spark, d).events
    anon = C("event_type") == "error"
    return e.select(
        C("event_id").alias("search_id"), F.when(~anon, C("user_id")).alias("user_id"), F.when(anon, F.concat(F.lit("a"), C("user_id").cast("string"))).alias("anon_id"),
        C("ts").cast("timestamp_ntz").alias("created_at"), F.get_json_object("props", "$.k").cast("long").alias("item"), (C("value") / 500).alias("confidence"),
        C("event_type").isin("view", "purchase").alias("from_camera"), F.when(C("event_id") % 10 == 0, C("ts").cast("timestamp_ntz")).alias("notified_at"),
    )


HIST = """hist AS (SELECT event_id AS search_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id, CASE WHEN event_type = 'error' THEN 'a' || user_id END AS anon_id, ts AS created_at, (props->>'k')::BIGINT AS item,
   value / 500 AS confidence, event_type IN ('view', 'purchase') AS from_camera, CASE WHEN event_id % 10 = 0 THEN ts END AS notified_at FROM events)"""


def favorites(spark, d):
    o = Tables(spark, d).orders
    return o.filter("o_orderstatus = 'F'").groupBy((C("o_custkey") % 150).alias("user_id"), (C("o_orderkey") % 100).alias("item")).agg(F.min("o_orderdate").cast("timestamp_ntz").alias("created_at"))


FAV = "fav AS (SELECT o_custkey % 150 AS user_id, o_orderkey % 100 AS item, min(o_orderdate) AS created_at FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"


def lines(spark, d):
    t = Tables(spark, d)
    return t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))


def reviews(spark, d, of=None):
    """`of`: the `lines`, if they are there already."""
    rows = (lines(spark, d) if of is None else of).select(
        C("o_custkey").alias("user_id"), C("l_partkey").alias("item"), F.when(C("l_linenumber") <= 5, C("l_linenumber")).alias("rating"),
        F.when(C("l_discount") >= 0.03, F.concat(F.lit("text "), "l_returnflag")).alias("comment"), C("l_shipdate").cast("timestamp_ntz").alias("updated_at"), "l_orderkey", "l_suppkey",
    )
    order = F.struct("updated_at", "l_orderkey", "l_suppkey", F.coalesce("rating", F.lit(0)), F.coalesce("comment", F.lit("")))
    return rows.groupBy("user_id", "item").agg(F.max_by(F.struct("rating", "comment", "updated_at"), order).alias("r")).select("user_id", "item", "r.*")


REV = """rev AS MATERIALIZED (SELECT user_id, item, rating, comment, updated_at FROM (SELECT o_custkey AS user_id, l_partkey AS item, CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS rating, CASE WHEN l_discount >= 0.03 THEN 'text ' || l_returnflag END AS comment, l_shipdate AS updated_at,
     row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_suppkey DESC, coalesce(CASE WHEN l_linenumber <= 5 THEN l_linenumber END, 0) DESC, coalesce(CASE WHEN l_discount >= 0.03 THEN 'text ' || l_returnflag END, '') DESC) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r = 1)"""


def reactions(spark, d, of=None):
    """One reaction per (reactor, author, item). `of`: the `lines`, if they are there already."""
    rows = lines(spark, d) if of is None else of
    return rows.groupBy(C("l_suppkey").alias("reactor"), C("o_custkey").alias("user_id"), C("l_partkey").alias("item")).agg(
        F.when(F.max("l_discount") >= 0.04, 1).otherwise(-1).alias("value"), F.max("l_shipdate").cast("timestamp_ntz").alias("updated_at")
    )


REA = "rea AS MATERIALIZED (SELECT l_suppkey AS reactor, o_custkey AS user_id, l_partkey AS item, CASE WHEN max(l_discount) >= 0.04 THEN 1 ELSE -1 END AS value, max(l_shipdate) AS updated_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def items(spark, d):
    return Tables(spark, d).part.filter("p_partkey % 10 <> 3").select(C("p_partkey").alias("item"), C("p_name").alias("name"))


ITM = "itm AS (SELECT p_partkey AS item, p_name AS name FROM part WHERE p_partkey % 10 <> 3)"


def changes(spark, d):
    e = Tables(spark, d).events
    return e.select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("item"), F.when(C("event_type") == "error", "delete").otherwise("put").alias("op"), "value",
        C("ts").cast("timestamp_ntz").alias("ts"), C("event_id").alias("seq"),
    )


def state(spark, d):
    return favorites(spark, d).withColumn("value", F.lit(1.5)).withColumn("updated_at", C("created_at"))


CHANGE_SQL = f"""{FAV}, ch AS (SELECT user_id, (props->>'k')::BIGINT AS item, event_type = 'error' AS del, value, ts, event_id FROM events),
   gone AS (SELECT user_id, item, max(event_id) FILTER (del) AS g FROM ch GROUP BY ALL),
   fresh AS (SELECT user_id, item, arg_max(value, event_id) AS last_v, arg_min(value, event_id) AS first_v, min(ts) AS f, max(ts) AS t FROM ch JOIN gone USING (user_id, item) WHERE NOT del AND (g IS NULL OR event_id > g) GROUP BY ALL),
   old AS (SELECT fav.*, 1.5::DOUBLE AS value FROM fav LEFT JOIN gone USING (user_id, item) WHERE g IS NULL)"""


@query("changes_upserted", "H1", f"WITH {CHANGE_SQL} SELECT user_id, item, coalesce(last_v, value) AS value, coalesce(created_at, f) AS created_at, coalesce(t, created_at) AS updated_at FROM old FULL JOIN fresh USING (user_id, item)")
def _(spark, d):
    return h.apply_changes(state(spark, d), changes(spark, d), ["user_id", "item"], ["value"], "upsert")


@query("changes_insert_ignore", "H1", f"WITH {CHANGE_SQL} SELECT user_id, item, coalesce(value, first_v) AS value, coalesce(created_at, f) AS created_at, coalesce(created_at, f) AS updated_at FROM old FULL JOIN fresh USING (user_id, item)")
def _(spark, d):
    return h.apply_changes(state(spark, d), changes(spark, d), ["user_id", "item"], ["value"], "insert_ignore")


@query("read_flags", "H1 update_where,delete_cascade", f"WITH {HIST} SELECT search_id, coalesce(notified_at, marked) AS notified_at FROM hist LEFT JOIN (SELECT event_id AS search_id, min(ts) + INTERVAL 1 HOUR AS marked FROM events WHERE event_type = 'click' GROUP BY 1) USING (search_id) WHERE search_id NOT IN (SELECT event_id FROM events WHERE value > 450)")
def _(spark, d):
    e = Tables(spark, d).events
    marks = e.filter("event_type = 'click'").select(C("event_id").alias("search_id"), (C("ts").cast("timestamp_ntz") + h.hours(1)).alias("at"))
    rows = h.update_where(history(spark, d).select("search_id", "notified_at"), marks, ["search_id"], "at", "notified_at")
    removed = e.filter("value > 450").select(C("event_id").alias("search_id"))
    return h.delete_cascade(rows, rows, removed, "search_id")[1]


@query(
    "recorded_searches", "H2",
    f"""SELECT event_id AS search_id, CASE WHEN event_type = 'signup' THEN user_id END AS user_id, CASE WHEN event_type <> 'signup' THEN 'a' || user_id END AS anon_id, CASE WHEN k % 10 <> 3 AND k IN (SELECT p_partkey FROM part) THEN k END AS top_item,
         10::BIGINT AS kept, round(value / 700 - 0.009, 6) AS last_score, event_id % 2 = 0 AS from_camera FROM (SELECT *, (props->>'k')::BIGINT AS k FROM events) WHERE event_type <> 'error'""",
)
def _(spark, d):
    e = Tables(spark, d).events
    k = F.get_json_object("props", "$.k").cast("long")
    results = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct((k + i).alias("item"), (C("value") / 700 - i / 1000).alias("score")))
    raw = e.select(
        C("event_id").alias("search_id"), F.when(C("event_type") == "signup", C("user_id")).alias("user_id"), F.when(C("event_type") != "error", F.concat(F.lit("a"), C("user_id").cast("string"))).alias("anon_id"),
        C("ts").alias("created_at"), results.alias("results"), (C("value") / 500).alias("confidence"), F.when(C("event_id") % 2 == 0, "camera").otherwise("gallery").alias("source"),
    )
    out = h.record_searches(raw, items(spark, d))
    return out.select("search_id", "user_id", "anon_id", "top_item", F.size("results").cast("long").alias("kept"), F.element_at("results", -1)["score"].alias("last_score"), "from_camera")


LOGIN = "logins AS (SELECT 'a' || user_id AS anon_id, user_id AS login_user, min(ts) + INTERVAL 5 DAY AS login_at FROM events GROUP BY user_id)"


def logins(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg((F.min("ts").cast("timestamp_ntz") + F.expr("INTERVAL 5 DAY")).alias("login_at")).select(F.concat(F.lit("a"), C("user_id").cast("string")).alias("anon_id"), C("user_id").alias("login_user"), "login_at")


CLAIMED = f"""{HIST}, {LOGIN}, cl AS (SELECT search_id, coalesce(user_id, CASE WHEN hit THEN login_user END) AS user_id, CASE WHEN NOT hit THEN anon_id END AS anon_id, created_at, item FROM (SELECT hist.*, login_user, coalesce(user_id IS NULL AND created_at <= login_at AND created_at >= login_at - INTERVAL 72 HOUR, false) AS hit FROM hist LEFT JOIN logins USING (anon_id)))"""


@query("claimed_history", "H3", f"WITH {CLAIMED} SELECT search_id, user_id, anon_id FROM cl")
def _(spark, d):
    return h.claim_anonymous(history(spark, d), logins(spark, d)).select("search_id", "user_id", "anon_id")


@query("kept_history", "H4", f"WITH {HIST} SELECT search_id FROM hist WHERE user_id IS NOT NULL OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR")
def _(spark, d):
    return h.expire_anonymous(history(spark, d), now()).select("search_id")


@query("history_pages", "H5", f"""WITH {HIST}, o AS (SELECT *, coalesce('user:' || user_id, 'anon:' || anon_id) AS owner FROM hist WHERE user_id IS NOT NULL OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR),
   r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, search_id) AS position, count(*) OVER (PARTITION BY owner) AS total FROM o) SELECT owner, position, search_id, total FROM r WHERE position BETWEEN 6 AND 15""")
def _(spark, d):
    return h.history_pages(history(spark, d), now(), 10, 5).select("owner", "position", "search_id", "total")


@query(
    "viewed_items", "H6",
    f"""WITH {HIST}, {FAV}, {REV}, {ITM}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY created_at DESC, search_id) AS r FROM hist WHERE user_id IS NOT NULL AND created_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}')
        SELECT l.user_id, l.item, l.search_id, l.created_at, fav.user_id IS NOT NULL AS is_favorite, rev.rating FROM l JOIN itm USING (item) LEFT JOIN fav ON fav.user_id = l.user_id AND fav.item = l.item LEFT JOIN rev ON rev.user_id = l.user_id AND rev.item = l.item WHERE r = 1""",
)
def _(spark, d):
    return h.viewed_items(history(spark, d), items(spark, d), favorites(spark, d), reviews(spark, d), now() - h.hours(24), now()).select("user_id", "item", "search_id", "created_at", "is_favorite", "rating")


@query("favorites_pages", "H7", f"WITH {FAV}, {ITM} SELECT user_id, item, position FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item) AS position FROM fav JOIN itm USING (item)) WHERE position <= 20")
def _(spark, d):
    return h.favorites_page(favorites(spark, d), items(spark, d), 20).select("user_id", "item", "position")


@query("review_summaries", "H8,A5", f"WITH {REV} SELECT item, count(*) AS reviews, count(rating) AS rated, round(avg(rating), 2) AS average, {', '.join(f'count_if(rating = {s})::BIGINT AS stars_{s}' for s in range(1, 6))} FROM rev GROUP BY item")
def _(spark, d):
    return h.review_summaries(reviews(spark, d))


@query(
    "review_feed", "H8,T4,F22",
    f"""WITH {REV}, {REA}, p AS (SELECT *, user_id = 77 AS is_mine, row_number() OVER (PARTITION BY item ORDER BY user_id <> 77, updated_at DESC, user_id) AS position FROM rev), a AS (SELECT user_id, count(comment) AS author_comments, count(*) AS author_reviews FROM rev GROUP BY user_id),
        c AS (SELECT user_id, item, count_if(value = 1) AS likes, count_if(value = -1) AS dislikes FROM rea GROUP BY ALL)
        SELECT p.item, p.position, p.user_id, is_mine, author_comments, author_reviews, CASE WHEN author_comments > 100 THEN 'diamond' WHEN author_comments >= 50 THEN 'gold' WHEN author_comments >= 10 THEN 'silver' WHEN author_comments >= 1 THEN 'bronze' ELSE 'none' END AS author_frame,
          coalesce(likes, 0)::BIGINT AS likes, coalesce(dislikes, 0)::BIGINT AS dislikes, m.value AS my_reaction FROM p JOIN a USING (user_id) LEFT JOIN c USING (user_id, item) LEFT JOIN (SELECT * FROM rea WHERE reactor = 7) m ON m.user_id = p.user_id AND m.item = p.item WHERE position <= 50""",
)
def _(spark, d):
    rea = reactions(spark, d)
    feed = h.review_feed(reviews(spark, d), rea, 77)
    own = rea.filter("reactor = 7").select("user_id", "item", C("value").alias("mine"))
    return feed.drop("my_reaction").join(own, ["user_id", "item"], "left").select("item", "position", "user_id", "is_mine", "author_comments", "author_reviews", "author_frame", "likes", "dislikes", C("mine").alias("my_reaction"))


@query("my_reviews", "H9", f"WITH {REV}, {REA}, {ITM}, c AS (SELECT user_id, item, count_if(value = 1) AS likes, count_if(value = -1) AS dislikes FROM rea GROUP BY ALL) SELECT user_id, rev.item, rating, comment, updated_at, coalesce(likes, 0)::BIGINT AS likes, coalesce(dislikes, 0)::BIGINT AS dislikes FROM rev JOIN itm USING (item) LEFT JOIN c USING (user_id, item)")
def _(spark, d):
    return h.my_reviews(reviews(spark, d), reactions(spark, d), items(spark, d))


@query(
    "review_photos", "H10",
    f"""WITH {REV}, ph AS (SELECT o_custkey AS user_id, l_partkey % 20 AS grp, l_partkey AS item, l_shipdate AS created_at, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS photo FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        k AS (SELECT ph.* FROM ph JOIN rev USING (user_id, item)), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, item) AS photos, row_number() OVER (PARTITION BY user_id, item ORDER BY created_at, photo) AS pos FROM k)
        SELECT user_id, item, photo, photos, pos > 5 AS over_cap, pos AS position FROM n""",
)
def _(spark, d):
    t = Tables(spark, d)
    ph = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(
        C("o_custkey").alias("user_id"), C("l_partkey").alias("item"), C("l_shipdate").alias("created_at"), F.concat_ws("-", C("l_orderkey").cast("string"), C("l_linenumber").cast("string"), C("l_suppkey").cast("string")).alias("photo"),
    )
    return h.review_photos(ph, reviews(spark, d)).select("user_id", "item", "photo", "photos", "over_cap", "position")


@query(
    "review_rules", "H11",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber <> 4 THEN l_linenumber END AS rating, CASE WHEN l_returnflag = 'N' THEN '  ' ELSE ' ok ' || repeat('x', CASE WHEN l_quantity > 49 THEN 2001 ELSE 1 END) END AS comment, l_orderkey AS nid, l_suppkey AS user_id FROM lineitem),
            n AS (SELECT o_orderkey AS nid, o_custkey % 100 AS owner FROM orders)
       SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, md5(coalesce(nullif(trim(comment), ''), '')) AS comment, CASE WHEN owner = user_id THEN r.nid END AS notification_id,
         concat_ws('; ', CASE WHEN rating IS NULL AND trim(comment) = '' THEN 'rating or comment required' END, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating out of range' END, CASE WHEN length(trim(comment)) > 2000 THEN 'comment too long' END) AS problems FROM r LEFT JOIN n USING (nid)""",
)
def _(spark, d):
    t = Tables(spark, d)
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(C("l_linenumber") != 4, C("l_linenumber")).alias("rating"),
        F.when(C("l_returnflag") == "N", "  ").otherwise(F.concat(F.lit(" ok "), F.when(C("l_quantity") > 49, F.repeat(F.lit("x"), 2001)).otherwise("x"))).alias("comment"), C("l_orderkey").alias("notification_id"), C("l_suppkey").alias("user_id"),
    )
    notes = t.orders.select(C("o_orderkey").alias("notification_id"), (C("o_custkey") % 100).alias("user_id"))
    out = h.check_reviews(rows, notes)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.md5(F.coalesce("comment", F.lit(""))).alias("comment"), "notification_id", F.array_join("problems", "; ").alias("problems"))


@query("accepted_reactions", "H11,J3", f"WITH {REV}, {REA} SELECT reactor, user_id, item, value FROM rea WHERE reactor <> user_id AND EXISTS (SELECT 1 FROM rev WHERE rev.user_id = rea.user_id AND rev.item = rea.item AND comment IS NOT NULL)")
def _(spark, d):
    return h.valid_reactions(reactions(spark, d), reviews(spark, d)).select("reactor", "user_id", "item", "value")


REMIND = f"""{HIST}, {FAV}, {REV}, due AS (SELECT user_id FROM hist WHERE user_id IS NOT NULL AND notified_at IS NULL AND created_at <= TIMESTAMP '{NOW}' GROUP BY user_id HAVING max(created_at) <= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE),
   opn AS (SELECT * FROM hist WHERE notified_at IS NULL AND created_at <= TIMESTAMP '{NOW}' AND user_id IN (SELECT user_id FROM due)),
   lv AS (SELECT user_id, item, created_at AS viewed_at, search_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY created_at DESC, search_id) AS r FROM opn WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) WHERE r = 1),
   ri AS (SELECT * FROM lv WHERE NOT EXISTS (SELECT 1 FROM fav WHERE fav.user_id = lv.user_id AND fav.item = lv.item) AND NOT EXISTS (SELECT 1 FROM rev WHERE rev.user_id = lv.user_id AND rev.item = lv.item))"""


def remind(spark, d):
    past = history(spark, d).filter(C("created_at") <= now())
    return h.reminders(past, favorites(spark, d), reviews(spark, d), now())


@query("reminder_notifications", "H12,A3", f"WITH {REMIND} SELECT user_id, count(*) AS items, min(viewed_at) AS period_start, max(viewed_at) AS period_end FROM ri GROUP BY user_id")
def _(spark, d):
    return remind(spark, d)[0]


@query("reminder_items", "H12,W1,J4", f"WITH {REMIND} SELECT user_id, item, viewed_at, search_id FROM ri")
def _(spark, d):
    return remind(spark, d)[1]


@query("reminder_processed", "H12", f"WITH {REMIND} SELECT search_id, user_id FROM opn")
def _(spark, d):
    return remind(spark, d)[2]


DIG = f"""{REA}, u AS (SELECT c_custkey AS user_id, (c_custkey % 4) * 20000 AS mins, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2001-06-01' - to_days((c_custkey % 60)::INT) END AS notified_at FROM customer),
   due AS (SELECT *, coalesce(notified_at, TIMESTAMP '2001-06-15' - to_minutes(mins)) AS period_start FROM u WHERE mins > 0 AND (notified_at IS NULL OR notified_at <= TIMESTAMP '2001-06-15' - to_minutes(mins)))"""


@query("reaction_digest", "H13,J6,A2", f"WITH {DIG} SELECT due.user_id, period_start, count(DISTINCT reactor) AS reactors FROM due LEFT JOIN rea ON rea.user_id = due.user_id AND updated_at > period_start AND updated_at <= TIMESTAMP '2001-06-15' GROUP BY ALL")
def _(spark, d):
    k = C("c_custkey")
    users = Tables(spark, d).customer.select(
        k.alias("user_id"), ((k % 4) * 20000).cast("int").alias("period_minutes"),
        F.when(k % 3 > 0, F.lit("2001-06-01").cast("timestamp_ntz") - F.make_dt_interval((k % 60).cast("int"))).alias("notified_at"),
    )
    return h.reaction_digest(users, reactions(spark, d), F.lit("2001-06-15").cast("timestamp_ntz")).select("user_id", "period_start", "reactors")


@query("notification_pages", "H14,A13", "WITH n AS (SELECT event_id, user_id, ts, event_id % 3 = 0 AS unread FROM events) SELECT user_id, event_id AS notification_id, position, total, unread FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position, count(*) OVER (PARTITION BY user_id) AS total, (count_if(unread) OVER (PARTITION BY user_id))::BIGINT AS unread FROM n) WHERE position <= 10")
def _(spark, d):
    e = Tables(spark, d).events
    notes = e.select("user_id", C("event_id").alias("notification_id"), C("ts").alias("created_at"), F.when(C("event_id") % 3 != 0, C("ts")).alias("read_at"))
    return h.notification_pages(notes, 10).select("user_id", "notification_id", "position", "total", "unread")


@query("profile_periods", "H15", "SELECT c_custkey, (c_custkey * 37) % 50000 BETWEEN 1 AND 43200 AS valid FROM customer")
def _(spark, d):
    return Tables(spark, d).customer.select("c_custkey", h.valid_period((C("c_custkey") * 37) % 50000).alias("valid"))


@query("assigned_nicknames", "F19")
def _(spark, d):
    people = Tables(spark, d).customer.select("c_custkey", F.when(C("c_custkey") % 3 == 0, C("c_name")).alias("nickname"))
    return h.assign_nicknames(people, "c_custkey", "nickname", "guest")
