"""Achievements over events (scans), part (catalogue), orders and line items (reviews, reactions, favourites)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions.values import local_time
from catalens.operators import badges as b
from catalens.plans import users as u
from catalens.plans.registry import Tables, query
from catalens.plans.scalars import ZONES
from catalens.session import materialize

C = F.col
RULES = b.BadgeRules(
    colors=(("ECONOMY", "red", ((10, False), (100, True), (None, True))), ("SMALL", "white", ((10, False), (100, True))), ("LARGE", "rose", ((10, False),))),
    dry="red", sweet=("blue", "small"), grapes=(("ring_10", "ring", False), ("bolt_10", "bolt", True)), white="SMALL", red="ECONOMY",
)


def items(spark, d):
    words = F.split("p_name", " ")
    return Tables(spark, d).part.select(
        C("p_partkey").alias("item"), F.when(C("p_size") > 4, F.concat(F.lit("Region "), (C("p_partkey") % 7).cast("string"))).alias("region"), C("p_type").alias("color"),
        F.element_at(words, 1).alias("sugar"), (C("p_size") % 6 == 0).alias("sparkling"), F.array(F.element_at(words, -1), C("p_brand")).alias("grapes"), C("p_brand").alias("producer"),
    )


ITEM = "itm AS (SELECT p_partkey AS item, CASE WHEN p_size > 4 THEN 'Region ' || (p_partkey % 7) END AS region, p_type AS color, split_part(p_name, ' ', 1) AS sugar, p_size % 6 = 0 AS sparkling, split_part(p_name, ' ', -1) AS grape, p_brand AS producer FROM part)"


def scans(spark, d):
    h = u.history(spark, d)
    zone = F.when(C("user_id") % 5 == 1, ZONES[1]).when(C("user_id") % 5 == 2, ZONES[2]).when(C("user_id") % 5 == 3, ZONES[3])
    h = h.withColumn("confidence", C("confidence") + 0.5).withColumn("local_ts", local_time(C("created_at").cast("timestamp"), zone).cast("timestamp_ntz"))
    return b.counted_scans(h, items(spark, d))


SCAN = f"""{u.HIST}, {ITEM}, sc AS MATERIALIZED (SELECT h.user_id, h.item, confidence + 0.5 AS confidence, timezone(CASE user_id % 5 WHEN 1 THEN '{ZONES[1]}' WHEN 2 THEN '{ZONES[2]}' WHEN 3 THEN '{ZONES[3]}' ELSE '{ZONES[0]}' END, timezone('UTC', created_at)) AS lts,
     region, color, sugar, sparkling, grape, producer FROM hist h JOIN itm ON itm.item = h.item WHERE user_id IS NOT NULL AND confidence + 0.5 >= 0.7 AND from_camera),
   uq AS (SELECT DISTINCT user_id, item, region, color, sugar, sparkling, grape, producer FROM sc),
   dd AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g FROM (SELECT DISTINCT user_id, lts::DATE AS day FROM sc)),
   st AS (SELECT user_id, max(n) AS longest_streak FROM (SELECT user_id, g, count(*) AS n FROM dd GROUP BY ALL) GROUP BY user_id),
   bd AS (SELECT user_id, max(n) AS most_items_in_a_day FROM (SELECT user_id, lts::DATE AS day, count(DISTINCT item) AS n FROM sc GROUP BY ALL) GROUP BY user_id),
   sp AS (SELECT user_id, max(n) AS same_producer FROM (SELECT user_id, producer, count(*) AS n FROM uq GROUP BY ALL) GROUP BY user_id),
   t1 AS (SELECT user_id, count_if(confidence >= 0.9) AS high_confidence, max((hour(lts) < 5)::INT) AS late_night, max((hour(lts) BETWEEN 6 AND 9)::INT) AS morning, max((dayofweek(lts) IN (0, 6))::INT) AS weekend,
       max((month(lts) IN (12, 1) AND sparkling)::INT) AS new_year_sparkling, max((month(lts) IN (6, 7, 8) AND color = 'SMALL')::INT) AS summer_white, max((month(lts) IN (9, 10, 11) AND color = 'ECONOMY')::INT) AS autumn_red FROM sc GROUP BY user_id),
   t2 AS (SELECT user_id, count(*) AS items, count(DISTINCT region) AS regions, count(DISTINCT color) AS colors, count(DISTINCT sugar) AS sugars, count(DISTINCT producer) AS producers, count_if(sparkling) AS sparkling, count_if(sugar = 'red') AS dry,
       count_if(sugar IN ('blue', 'small')) AS sweet, count_if(contains(grape, 'ring') OR contains(producer, 'ring')) AS "grape:ring_10", count_if(contains(grape, 'bolt') OR contains(producer, 'bolt')) AS "grape:bolt_10" FROM uq GROUP BY user_id),
   gv AS (SELECT user_id, unnest([grape, producer]) AS g FROM uq), rr AS (SELECT g FROM (SELECT unnest([grape, producer]) AS g FROM itm) GROUP BY g HAVING count(*) <= 3),
   t3 AS (SELECT user_id, count(DISTINCT gv.g) AS grapes, coalesce(max((rr.g IS NOT NULL)::INT), 0) AS rare_grape FROM gv LEFT JOIN rr ON rr.g = gv.g GROUP BY user_id),
   wide AS (SELECT * FROM t1 JOIN t2 USING (user_id) JOIN t3 USING (user_id) JOIN st USING (user_id) JOIN bd USING (user_id) JOIN sp USING (user_id)),
   sm AS (SELECT user_id, metric, value::BIGINT AS value FROM (UNPIVOT (SELECT user_id, COLUMNS(* EXCLUDE (user_id))::BIGINT FROM wide) ON COLUMNS(* EXCLUDE (user_id)) INTO NAME metric VALUE value)
     UNION ALL SELECT user_id, 'region:' || region, count(*) FROM uq WHERE region IS NOT NULL GROUP BY ALL UNION ALL SELECT user_id, 'color:' || color, count(*) FROM uq GROUP BY ALL)"""


def scan_rows(spark, d):
    return b.scan_metrics(scans(spark, d), items(spark, d), RULES)


@query("scan_metrics", "B1,B2,B3,B4", f"WITH {SCAN} SELECT user_id, metric, value FROM sm")
def _(spark, d):
    return scan_rows(spark, d)


def social_rows(spark, d):
    columns = ["o_custkey", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate"]
    lines = materialize(u.lines(spark, d).select(*columns), "lines", large=True).repartition("o_custkey")  # joined once; grouped by author where they then lie
    rev = u.reviews(spark, d, lines).withColumn("notification_id", F.when(C("item") % 9 == 0, C("item")))
    fav = u.favorites(spark, d).withColumn("search_id", F.when(C("item") % 4 == 0, C("item")))
    return b.social_metrics(rev, u.reactions(spark, d, lines), fav)


SOCIAL_METRICS = """s1 AS (SELECT user_id, count(comment) AS comments, count(DISTINCT rating) AS ratings, max(coalesce(rating = 5, false)::INT) AS five_star, max((item % 9 = 0)::INT) AS review_from_notification FROM rev GROUP BY user_id),
   s2 AS (SELECT reactor AS user_id, count_if(value = 1) AS likes_given, count_if(value = -1) AS dislikes_given, least(count_if(value = 1), 5) + least(count_if(value = -1), 5) AS civil FROM rea GROUP BY reactor),
   s3 AS (SELECT user_id, max(n) AS best_likes FROM (SELECT user_id, item, count_if(value = 1) AS n FROM rea GROUP BY ALL) GROUP BY user_id),
   s4 AS (SELECT user_id, count(*) AS favorites, max((item % 4 = 0)::INT) AS favorite_after_scan FROM fav GROUP BY user_id),
   so AS (SELECT user_id, unnest(['comments', 'ratings', 'five_star', 'review_from_notification']) AS metric, unnest([comments, ratings, five_star, review_from_notification])::BIGINT AS value FROM s1
     UNION ALL SELECT user_id, unnest(['likes_given', 'dislikes_given', 'civil']), unnest([likes_given, dislikes_given, civil])::BIGINT FROM s2 UNION ALL SELECT user_id, 'best_likes', best_likes::BIGINT FROM s3
     UNION ALL SELECT user_id, unnest(['favorites', 'favorite_after_scan']), unnest([favorites, favorite_after_scan])::BIGINT FROM s4)"""
SOCIAL = f"{u.REV}, {u.REA}, {u.FAV}, {SOCIAL_METRICS}"


@query("social_metrics", "B1,A4", f"WITH {SOCIAL} SELECT user_id, metric, value FROM so")
def _(spark, d):
    return social_rows(spark, d)


def fixed_sql() -> str:
    rows = [(1, i, *x, False, None) for i, x in enumerate(b.SCAN_BADGES)] + [(3, i, *x, False, None) for i, x in enumerate(b.REGION_BADGES)]
    rows += [(3, 9, "regions_all", "regions", None, "regions", True, "regions", False, "regions")]
    rows += [(4, 0, "red_wines_10", "styles", 10, "color:ECONOMY", False, "red_wines", False, None), (4, 1, "red_wines_100", "styles", 100, "color:ECONOMY", True, "red_wines", False, None), (4, 2, "red_wines_all", "styles", None, "color:ECONOMY", True, "red_wines", False, "n_red"),
             (4, 3, "white_wines_10", "styles", 10, "color:SMALL", False, "white_wines", False, None), (4, 4, "white_wines_100", "styles", 100, "color:SMALL", True, "white_wines", False, None), (4, 5, "rose_wines_10", "styles", 10, "color:LARGE", False, "rose_wines", False, None)]
    rows += [(5, i, *x, False, None) for i, x in enumerate(b.STYLE_BADGES)] + [(5, 8, "all_colors", "styles", None, "colors", True, None, False, "colors"), (5, 9, "all_sugar_styles", "styles", None, "sugars", True, None, False, "sugars")]
    rows += [(6, 0, "ring_10", "grapes", 10, "grape:ring_10", False, None, False, None), (6, 1, "bolt_10", "grapes", 10, "grape:bolt_10", True, None, False, None)]
    rows += [(7, i, *x, False, None) for i, x in enumerate(b.LATER_BADGES)] + [(8, i, *x, True, None) for i, x in enumerate(b.META_BADGES)]
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(say(v) for v in row) + ")" for row in rows)


BADGE = f"""fx(part, i, code, category, target, metric, hidden, series, meta, src) AS (VALUES {fixed_sql()}),
   tot AS (SELECT count(DISTINCT region) AS regions, count(DISTINCT color) AS colors, count(DISTINCT sugar) AS sugars, count_if(color = 'ECONOMY') AS n_red FROM itm),
   rs AS (SELECT region, count(*) AS size FROM itm WHERE region IS NOT NULL GROUP BY region),
   rg AS (SELECT region, size, unnest(list_concat(list_filter([1, 10, 100, 200, 500], lambda t: t < size), [size])) AS target FROM rs),
   bb AS (SELECT part, i::BIGINT AS a, '' AS b, 0::BIGINT AS c, code, category, coalesce(target, CASE src WHEN 'regions' THEN regions WHEN 'colors' THEN colors WHEN 'sugars' THEN sugars WHEN 'n_red' THEN n_red END) AS target, metric, hidden, series, meta FROM fx, tot
     UNION ALL SELECT 2, -size, region, target, 'region_' || replace(lower(region), ' ', '_') || '_' || CASE WHEN target = size THEN 'all' ELSE target::VARCHAR END, 'regions', target, 'region:' || region, true, 'region_' || replace(lower(region), ' ', '_'), false FROM rg),
   badge AS MATERIALIZED (SELECT row_number() OVER (ORDER BY part, a, b, c) AS pos, code, category, coalesce(target, (SELECT count(*) FROM bb WHERE NOT meta))::BIGINT AS target, metric, hidden, series, meta FROM bb)"""


def catalog(spark, d):
    return b.build_catalog(items(spark, d), RULES)


@query("badge_catalog", "B5,A10", f"WITH {ITEM}, {BADGE} SELECT * FROM badge")
def _(spark, d):
    return catalog(spark, d)


def players(spark, d):
    return Tables(spark, d).events.select("user_id").distinct()


def earned_before(spark, d):
    e = Tables(spark, d).events
    rows = e.filter("user_id % 4 = 0").groupBy("user_id").agg(F.min("ts").cast("timestamp_ntz").alias("earned_at"))
    return rows.select("user_id", F.explode(F.array(F.lit("first_scan"), F.lit("scan_streak_7"))).alias("code"), "earned_at")


def states(spark, d):
    e = Tables(spark, d).events
    rows = e.filter("user_id % 4 < 2").groupBy("user_id").agg(F.min("ts").cast("timestamp_ntz").alias("t"))
    k = F.explode(F.array(F.struct(F.lit("scan_25_wines").alias("code"), F.lit(3).alias("p")), F.struct(F.lit("grapes_10").alias("code"), F.lit(2).alias("p")), F.struct(F.lit("regions_7").alias("code"), F.lit(0).alias("p"))))
    return rows.select("user_id", "t", k.alias("s")).select("user_id", "s.code", C("s.p").cast("long").alias("state_progress"), C("s.p").cast("long").alias("notified_progress"), F.when(C("user_id") % 8 == 0, C("t")).otherwise(F.lit(u.NOW).cast("timestamp_ntz")).alias("notified_at"))


def progress_rows(spark, d):
    metrics = scan_rows(spark, d).unionByName(social_rows(spark, d))
    return b.with_visibility(b.progress(players(spark, d), catalog(spark, d), metrics, earned_before(spark, d)))


STANDING = """met AS (SELECT * FROM sm UNION ALL SELECT * FROM so), eb AS (SELECT user_id, unnest(['first_scan', 'scan_streak_7']) AS code, min(ts) AS earned_at FROM events WHERE user_id % 4 = 0 GROUP BY user_id),
   g0 AS MATERIALIZED (SELECT pl.user_id, badge.*, least(coalesce(value, 0), target) AS v, earned_at FROM pl CROSS JOIN badge LEFT JOIN met ON met.user_id = pl.user_id AND met.metric = badge.metric LEFT JOIN eb ON eb.user_id = pl.user_id AND eb.code = badge.code),
   ms AS (SELECT user_id, count_if(got) AS n, max((got AND hidden)::INT) AS h FROM (SELECT *, NOT meta AND (earned_at IS NOT NULL OR v >= target) AS got FROM g0) GROUP BY user_id),
   g1 AS (SELECT g0.* EXCLUDE (v), CASE WHEN meta THEN least(CASE metric WHEN 'earned' THEN n ELSE h END, target) ELSE v END AS progress FROM g0 JOIN ms USING (user_id)),
   g2 AS (SELECT *, earned_at IS NULL AND progress >= target AS newly_earned, earned_at IS NOT NULL OR progress >= target AS earned FROM g1),
   g3 AS MATERIALIZED (SELECT * EXCLUDE (prev), earned OR CASE WHEN series IS NULL THEN NOT hidden WHEN prev IS NULL THEN NOT hidden ELSE prev END AS visible FROM (SELECT *, lag(earned) OVER (PARTITION BY user_id, series ORDER BY pos) AS prev FROM g2))"""
PROG = f"{SCAN}, {SOCIAL}, {BADGE}, pl AS (SELECT DISTINCT user_id FROM events), {STANDING}"


@query("badge_progress", "B6,B7,W6", f"WITH {PROG} SELECT user_id, pos, code, progress::BIGINT AS progress, target, newly_earned, earned, visible FROM g3")
def _(spark, d):
    return progress_rows(spark, d).select("user_id", "pos", "code", "progress", "target", "newly_earned", "earned", "visible")


NOTE = f"""{PROG}, sta AS (SELECT user_id, unnest(['scan_25_wines', 'grapes_10', 'regions_7']) AS code, unnest([3, 2, 0]) AS sp, CASE WHEN user_id % 8 = 0 THEN min(ts) ELSE TIMESTAMP '{u.NOW}' END AS na FROM events WHERE user_id % 4 < 2 GROUP BY user_id),
   n0 AS (SELECT g3.*, coalesce(sp, 0) AS sp, na, user_id % 4 >= 2 AS first_check FROM g3 LEFT JOIN sta USING (user_id, code)),
   n1 AS (SELECT *, NOT earned AND visible AND progress > sp AND (sp = 0 OR na IS NULL OR na <= TIMESTAMP '{u.NOW}' - INTERVAL 10 MINUTE OR len(list_filter([0.1, 0.25, 0.5, 0.75, 0.9], lambda m: sp / target < m AND progress / target >= m)) > 0) AS moved FROM n0),
   n2 AS MATERIALIZED (SELECT *, moved AND row_number() OVER (PARTITION BY user_id, moved ORDER BY progress / target DESC, pos) <= 2 AS notified FROM n1)"""


def noted(spark, d):
    return b.notify_updates(progress_rows(spark, d), states(spark, d), u.now())


@query(
    "badge_announcements", "B8,W7",
    f"""WITH {NOTE}, c AS (SELECT user_id, count_if(newly_earned) AS n, count(*) AS al FROM n2 WHERE first_check GROUP BY user_id HAVING count_if(newly_earned) > 3)
        SELECT user_id, CASE WHEN newly_earned THEN 'earned' ELSE 'progress' END AS kind, code, progress::BIGINT AS progress, target FROM n2 WHERE (newly_earned OR (notified AND NOT first_check)) AND user_id NOT IN (SELECT user_id FROM c)
        UNION ALL SELECT user_id, 'summary', 'summary', n::BIGINT, al FROM c""",
)
def _(spark, d):
    return b.announcements(noted(spark, d))


@query("badge_state_delta", "B9", f"WITH {NOTE} SELECT user_id, code, progress::BIGINT AS progress, (CASE WHEN notified THEN progress ELSE sp END)::BIGINT AS notified_progress, CASE WHEN notified THEN TIMESTAMP '{u.NOW}' ELSE na END AS notified_at FROM n2 WHERE progress <> sp OR notified OR first_check")
def _(spark, d):
    return b.state_delta(noted(spark, d), u.now())


@query(
    "badge_list", "B10",
    f"""WITH {ITEM}, {BADGE}, pl AS (SELECT DISTINCT user_id FROM events), eb AS (SELECT user_id, unnest(['first_scan', 'scan_streak_7']) AS code, min(ts) AS earned_at FROM events WHERE user_id % 4 = 0 GROUP BY user_id),
        sta AS (SELECT user_id, unnest(['scan_25_wines', 'grapes_10', 'regions_7']) AS code, unnest([3, 2, 0]) AS sp FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 4 < 2)),
        g AS (SELECT pl.user_id, badge.*, earned_at, CASE WHEN earned_at IS NOT NULL THEN target ELSE least(coalesce(sp, 0), target) END AS progress FROM pl CROSS JOIN badge LEFT JOIN eb USING (user_id, code) LEFT JOIN sta USING (user_id, code)),
        w AS (SELECT *, lag(earned_at IS NOT NULL) OVER (PARTITION BY user_id, series ORDER BY pos) AS prev FROM g)
        SELECT user_id, pos, code, progress::BIGINT AS progress, target, earned_at IS NOT NULL AS earned, earned_at, hidden AND series IS NULL AS secret,
          round(coalesce((SELECT count(*) FROM eb e2 WHERE e2.code = w.code), 0) * 100.0 / (SELECT count(DISTINCT user_id) FROM eb), 2) AS earned_by_percent
        FROM w WHERE earned_at IS NOT NULL OR CASE WHEN series IS NULL OR prev IS NULL THEN NOT hidden ELSE prev END""",
)
def _(spark, d):
    return b.badge_list(catalog(spark, d), players(spark, d), states(spark, d), earned_before(spark, d))


@query(
    "leaderboard", "B11,W4",
    """WITH s AS (SELECT o_custkey AS user_id, count(*) AS earned, max(o_orderdate) AS last_earned FROM orders GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY earned DESC, last_earned, c_nationkey, user_id) AS rank, user_id, earned, count(*) OVER () AS total FROM s JOIN customer ON c_custkey = user_id)
       SELECT rank, user_id, earned, total, user_id = 77 AS is_me FROM r WHERE rank BETWEEN 21 AND 40 OR user_id = 77""",
)
def _(spark, d):
    t = Tables(spark, d)
    earned = t.orders.select(C("o_custkey").alias("user_id"), C("o_orderkey").alias("code"), C("o_orderdate").alias("earned_at"))
    people = t.customer.select(C("c_custkey").alias("user_id"), C("c_nationkey").alias("created_at"))
    return b.leaderboard_page(b.leaderboard(earned, people), 77, 20, 20).select("rank", "user_id", "earned", "total", "is_me")
