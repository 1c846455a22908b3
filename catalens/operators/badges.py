"""Achievements: per-user metrics, a data-driven badge catalogue, progress, visibility, updates, leaderboard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions.text import to_search_latin
from catalens.operators.aggregates import busiest_day, enumerate_rows, longest_streak, one
from catalens.session import materialize

# --- fixed values ----------------------------------------------------------------------------------
SCAN_CONFIDENCE, HIGH_CONFIDENCE = 0.7, 0.9
REGION_TIERS = (1, 10, 100, 200, 500)
RARE_ITEMS = 3
MILESTONES = (0.1, 0.25, 0.5, 0.75, 0.9)
QUIET_MINUTES, MAX_UPDATES, FIRST_CHECK_LIMIT = 10, 2, 3
LEADERBOARD_SIZE = 20


@dataclass(frozen=True)
class BadgeRules:
    """Catalogue values the fixed badges refer to."""

    colors: tuple = (
        ("Красное", "red", ((10, False), (100, True), (None, True))), ("Белое", "white", ((10, False), (100, True))),
        ("Розовое", "rose", ((10, False),)), ("Оранжевое", "orange", ((5, True),)),
    )
    dry: str = "сухое"
    sweet: tuple[str, ...] = ("сладкое", "полусладкое")
    grapes: tuple = (
        ("saperavi_10", "Саперави", False), ("krasnostop_10", "Красностоп", True), ("riesling_10", "Рислинг", False),
        ("chardonnay_10", "Шардоне", False), ("pinot_noir_10", "Пино Нуар", True),
    )
    white: str = "Белое"
    red: str = "Красное"


# (code, category, target, metric, hidden, series)
SCAN_BADGES = (
    ("first_scan", "scans", 1, "items", True, "scans"), ("scan_5_wines", "scans", 5, "items", False, "scans"), ("scan_25_wines", "scans", 25, "items", False, "scans"),
    ("scan_100_wines", "scans", 100, "items", False, "scans"), ("scan_500_wines", "scans", 500, "items", True, "scans"), ("scan_1000_wines", "scans", 1000, "items", True, "scans"),
    ("high_confidence_scan", "scans", 1, "high_confidence", False, "high_confidence"), ("high_confidence_10", "scans", 10, "high_confidence", True, "high_confidence"),
)
REGION_BADGES = (("regions_3", "regions", 3, "regions", False, "regions"), ("regions_7", "regions", 7, "regions", False, "regions"))
STYLE_BADGES = (
    ("sparkling_wines_10", "styles", 10, "sparkling", False, None), ("dry_wines_25", "styles", 25, "dry", False, None), ("sweet_wines_10", "styles", 10, "sweet", False, None),
)
LATER_BADGES = (
    ("grapes_10", "grapes", 10, "grapes", False, "grapes"), ("grapes_50", "grapes", 50, "grapes", True, "grapes"), ("rare_grape", "grapes", 1, "rare_grape", True, None),
    ("producers_5", "producers", 5, "producers", False, "producers"), ("producers_25", "producers", 25, "producers", False, "producers"), ("producers_100", "producers", 100, "producers", True, "producers"),
    ("same_producer_10", "producers", 10, "same_producer", True, None),
    ("first_review", "social", 1, "comments", False, "reviews"), ("reviews_10", "social", 10, "comments", False, "reviews"), ("reviews_50", "social", 50, "comments", True, "reviews"), ("reviews_100", "social", 100, "comments", True, "reviews"),
    ("five_star_review", "social", 1, "five_star", False, None), ("balanced_critic", "social", 5, "ratings", True, None),
    ("comment_likes_1", "social", 1, "best_likes", False, "comment_likes"), ("comment_likes_10", "social", 10, "best_likes", True, "comment_likes"), ("comment_likes_50", "social", 50, "best_likes", True, "comment_likes"),
    ("liked_others_10", "social", 10, "likes_given", False, None), ("disliked_others_10", "social", 10, "dislikes_given", True, None), ("civil_balance", "social", 10, "civil", True, None),
    ("review_after_notification", "social", 1, "review_from_notification", True, None),
    ("first_favorite", "favorites", 1, "favorites", False, "favorites"), ("favorites_10", "favorites", 10, "favorites", False, "favorites"), ("favorites_50", "favorites", 50, "favorites", True, "favorites"),
    ("favorite_after_scan", "favorites", 1, "favorite_after_scan", False, None),
    ("scan_streak_3", "time", 3, "longest_streak", False, "streak"), ("scan_streak_7", "time", 7, "longest_streak", True, "streak"), ("scan_streak_30", "time", 30, "longest_streak", True, "streak"),
    ("scan_late_night", "time", 1, "late_night", True, None), ("scan_morning", "time", 1, "morning", True, None), ("scan_many_one_day", "time", 20, "most_items_in_a_day", True, None),
    ("weekend_scan", "time", 1, "weekend", False, None), ("new_year_sparkling", "time", 1, "new_year_sparkling", True, None), ("summer_white", "time", 1, "summer_white", True, None), ("autumn_red", "time", 1, "autumn_red", True, None),
)
META_BADGES = (
    ("achievements_5", "meta", 5, "earned", False, "achievements"), ("achievements_25", "meta", 25, "earned", False, "achievements"), ("achievements_50", "meta", 50, "earned", True, "achievements"),
    ("achievements_all", "meta", None, "earned", True, "achievements"), ("secret_achievement", "meta", 1, "hidden_earned", True, None),
)
# ----------------------------------------------------------------------------------------------------

PREVIOUS = "previous_earned"  # whether the badge before in the series is earned, null for the first

BADGE_SCHEMA = "pos long, code string, category string, target long, metric string, hidden boolean, series string, meta boolean"


def counted_scans(history: DataFrame, items: DataFrame) -> DataFrame:
    """Scans that count: an account, a known item, camera, confidence ≥ .7; with item attributes."""
    good = history.filter(F.col("user_id").isNotNull() & F.col("item").isNotNull() & (F.col("confidence") >= SCAN_CONFIDENCE) & F.col("from_camera"))
    return good.join(items, "item")


def scan_metrics(scans: DataFrame, items: DataFrame, rules: BadgeRules = BadgeRules()) -> DataFrame:
    """(user_id, metric, value) from counted scans with `local_ts`, region, color, sugar, sparkling, grapes, producer."""
    scans = materialize(scans, "scans", large=True)  # each group of metrics reads them, and the distinct ones
    at = F.col("local_ts")
    has_grape = lambda fragment: F.exists("grapes", lambda g: F.contains(g, F.lit(fragment)))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("long"))
    times = scans.groupBy("user_id").agg(
        F.count_if(F.col("confidence") >= HIGH_CONFIDENCE).alias("high_confidence"), any_(F.hour(at) < 5).alias("late_night"), any_((F.hour(at) >= 6) & (F.hour(at) < 10)).alias("morning"),
        any_(F.weekday(at) >= 5).alias("weekend"), any_(F.month(at).isin(12, 1) & F.col("sparkling")).alias("new_year_sparkling"),
        any_(F.month(at).isin(6, 7, 8) & (F.col("color") == rules.white)).alias("summer_white"), any_(F.month(at).isin(9, 10, 11) & (F.col("color") == rules.red)).alias("autumn_red"),
    )
    unique = materialize(scans.select("user_id", "item").distinct().join(items, "item"), "unique-scans", large=True)
    spread = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    counts = unique.groupBy("user_id").agg(
        one("items"), spread("region").alias("regions"), spread("color").alias("colors"), spread("sugar").alias("sugars"), spread("producer").alias("producers"),
        F.count_if("sparkling").alias("sparkling"), F.count_if(F.col("sugar") == rules.dry).alias("dry"), F.count_if(F.col("sugar").isin(*rules.sweet)).alias("sweet"),
        *[F.count_if(has_grape(fragment)).alias(f"grape:{code}") for code, fragment, _ in rules.grapes],
    )
    each = unique.select("user_id", F.explode(F.array(F.concat(F.lit("region:"), "region"), F.concat(F.lit("color:"), "color"))).alias("metric"))
    each = each.filter(F.col("metric").isNotNull()).groupBy("user_id", "metric").agg(one("value"))
    grapes = unique.select("user_id", F.explode("grapes").alias("grape"))
    rare = items.select(F.explode("grapes").alias("grape")).groupBy("grape").agg(one("n")).filter(F.col("n") <= RARE_ITEMS).select("grape", F.lit(1).cast("long").alias("is_rare"))
    vines = grapes.join(rare, "grape", "left").groupBy("user_id").agg(F.count_distinct("grape").alias("grapes"), F.coalesce(F.max("is_rare"), F.lit(0)).alias("rare_grape"))
    brand = unique.groupBy("user_id", "producer").agg(one("n")).groupBy("user_id").agg(F.max("n").alias("same_producer"))
    days = scans.withColumn("_day", F.to_date("local_ts"))
    wide = [times, counts, vines, brand, longest_streak(days, "user_id", "_day"), busiest_day(days, "user_id", "_day", "item")]
    return _union([unpivot(w, "user_id") for w in wide] + [each])


def social_metrics(reviews: DataFrame, reactions: DataFrame, favorites: DataFrame) -> DataFrame:
    """(user_id, metric, value) from reviews, reactions given and received, favourites."""
    wrote = reviews.groupBy("user_id").agg(
        F.count_if(F.col("comment") != "").alias("comments"), F.count_distinct(F.when(F.col("rating") > 0, F.col("rating"))).alias("ratings"),
        F.max(F.coalesce(F.col("rating") == 5, F.lit(False)).cast("long")).alias("five_star"), F.max(F.col("notification_id").isNotNull().cast("long")).alias("review_from_notification"),
    )
    gave = reactions.groupBy(F.col("reactor").alias("user_id")).agg(F.count_if(F.col("value") == 1).alias("likes_given"), F.count_if(F.col("value") == -1).alias("dislikes_given"))
    gave = gave.withColumn("civil", F.least("likes_given", F.lit(5)) + F.least("dislikes_given", F.lit(5)))
    got = reactions.groupBy("user_id", "item").agg(F.count_if(F.col("value") == 1).alias("n")).groupBy("user_id").agg(F.max("n").alias("best_likes"))
    kept = favorites.groupBy("user_id").agg(one("favorites"), F.max(F.col("search_id").isNotNull().cast("long")).alias("favorite_after_scan"))
    return _union([unpivot(w, "user_id") for w in (wrote, gave, got, kept)])


def unpivot(df: DataFrame, key: str) -> DataFrame:
    names = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(f"`{c}`").cast("long").alias(c) for c in names]).unpivot(key, [F.col(f"`{c}`").alias(c) for c in names], "metric", "value")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def build_catalog(items: DataFrame, rules: BadgeRules = BadgeRules()) -> DataFrame:
    """The badge table in definition order; region, colour and sugar targets come from the catalogue."""
    spark = items.sparkSession
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    sizes = items.filter(filled("region").isNotNull()).groupBy("region").agg(one("size"))
    tiers = F.array_union(F.filter(F.array(*[F.lit(t).cast("long") for t in REGION_TIERS]), lambda t: t < F.col("size")), F.array("size"))
    slug = F.regexp_replace(F.trim(F.regexp_replace(to_search_latin(F.lower("region")), "[—\\s]+", " ")), " ", "_")
    regional = sizes.select("region", "size", slug.alias("slug"), F.explode(tiers).alias("target")).select(
        F.struct(F.lit(2).alias("part"), (-F.col("size")).alias("a"), F.col("region").alias("b"), F.col("target").alias("c")).alias("ord"),
        F.concat(F.lit("region_"), "slug", F.lit("_"), F.when(F.col("target") == F.col("size"), "all").otherwise(F.col("target").cast("string"))).alias("code"),
        F.lit("regions").alias("category"), "target", F.concat(F.lit("region:"), "region").alias("metric"), F.lit(True).alias("hidden"), F.concat(F.lit("region_"), "slug").alias("series"), F.lit(False).alias("meta"),
    )
    totals = items.agg(
        F.count_distinct(filled("region")).alias("regions"), F.count_distinct(filled("color")).alias("colors"), F.count_distinct(filled("sugar")).alias("sugars"),
        *[F.count_if(F.col("color") == color).alias(f"n_{code}") for color, code, _ in rules.colors],
    )
    rows = [(1, i, *b, False, None) for i, b in enumerate(SCAN_BADGES)] + [(3, i, *b, False, None) for i, b in enumerate(REGION_BADGES)]
    rows.append((3, 9, "regions_all", "regions", None, "regions", True, "regions", False, "regions"))
    place = 0
    for color, code, steps in rules.colors:
        for target, hidden in steps:
            rows.append((4, place, f"{code}_wines_", "styles", target, f"color:{color}", hidden, f"{code}_wines", False, f"n_{code}"))
            place += 1
    rows += [(5, i, *b, False, None) for i, b in enumerate(STYLE_BADGES)]
    rows += [(5, 8, "all_colors", "styles", None, "colors", True, None, False, "colors"), (5, 9, "all_sugar_styles", "styles", None, "sugars", True, None, False, "sugars")]
    rows += [(6, i, code, "grapes", 10, f"grape:{code}", hidden, None, False, None) for i, (code, _, hidden) in enumerate(rules.grapes)]
    rows += [(7, i, *b, False, None) for i, b in enumerate(LATER_BADGES)] + [(8, i, *b, True, None) for i, b in enumerate(META_BADGES)]
    fixed = spark.createDataFrame(rows, "part int, i long, code string, category string, target long, metric string, hidden boolean, series string, meta boolean, from_total string")
    lookup = F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    fixed = fixed.join(F.broadcast(totals.select(lookup.alias("totals"))))  # single row
    size = F.element_at("totals", F.coalesce("from_total", F.lit("")))
    target = F.coalesce("target", size)
    code = F.when(F.endswith("code", F.lit("_wines_")), F.concat("code", F.when(target == size, "all").otherwise(target.cast("string")))).otherwise(F.col("code"))
    static = fixed.select(
        F.struct("part", F.col("i").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c")).alias("ord"), code.alias("code"), "category", target.alias("target"), "metric", "hidden", "series", "meta"
    )
    both = regional.unionByName(static)
    regular = both.filter("NOT meta").agg(one("regular"))
    both = both.join(F.broadcast(regular)).withColumn("target", F.coalesce("target", "regular"))  # single row
    # one row per badge
    return both.withColumn("pos", F.row_number().over(Window.orderBy("ord")).cast("long")).select("pos", "code", "category", "target", "metric", "hidden", "series", "meta")


def progress(users: DataFrame, badges: DataFrame, metrics: DataFrame, earned: DataFrame) -> DataFrame:
    """Every (user, badge) with progress capped at its target; meta badges count what is earned after the rest.

    `earned`: (user_id, code, earned_at). Earned badges stay earned, whatever the metric says now.
    """
    # the badge table is one bounded list in order of its rows; `before`: place in it of the badge that comes before in the series
    behind = F.lag("pos").over(Window.partitionBy("series").orderBy("pos"))
    listed = badges.withColumn("before", F.when(F.col("series").isNotNull(), behind)).groupBy().agg(F.array_sort(F.collect_list(F.struct(*_first("pos", badges.columns), "before"))).alias("_all"))
    # what is known of a user are two maps, bounded by the kinds of metrics and badges; they are stored once, and the grid is opened from there as often as it is read
    values = metrics.filter("value IS NOT NULL").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_values"))
    had = earned.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "earned_at"))).alias("_had"))
    known = materialize(users.select("user_id").join(values, "user_id", "left").join(had, "user_id", "left"), "standing", large=True)
    rows = known.repartition("user_id").join(F.broadcast(listed))  # a user's badges lie together from here on
    value = lambda b: F.least(F.coalesce(F.try_element_at("_values", b["metric"]), F.lit(0)), b["target"])
    when = lambda b: F.try_element_at("_had", b["code"])
    judged = F.transform("_all", lambda b: F.struct(b.alias("b"), value(b).alias("value"), when(b).alias("earned_at")))
    rows = rows.select("user_id", judged.alias("_b"))
    got = lambda x: ~x["b"]["meta"] & (x["earned_at"].isNotNull() | (x["value"] >= x["b"]["target"]))
    sums = {"_earned": F.size(F.filter("_b", got)).cast("long"), "_hidden": F.exists("_b", lambda x: got(x) & x["b"]["hidden"]).cast("long")}
    meta = lambda b: F.when(b["metric"] == "earned", F.col("_earned")).otherwise(F.col("_hidden"))
    reached = lambda x: F.when(x["b"]["meta"], F.least(meta(x["b"]), x["b"]["target"])).otherwise(x["value"])
    rows = rows.withColumns(sums).withColumn("_b", F.transform("_b", lambda x: F.struct(x["b"].alias("b"), x["earned_at"].alias("earned_at"), reached(x).alias("progress"))))
    holds = lambda x: x["earned_at"].isNotNull() | (x["progress"] >= x["b"]["target"])
    rows = rows.withColumn("_holds", F.transform("_b", lambda x: F.struct(x["b"]["pos"].alias("pos"), holds(x).alias("earned"))))
    before = lambda x: F.get(F.filter("_holds", lambda h: h["pos"] == x["b"]["before"]), F.lit(0))["earned"]
    opened = F.transform("_b", lambda x: F.struct(x.alias("x"), F.when(x["b"]["before"].isNotNull(), before(x)).alias("previous")))
    rows = rows.select("user_id", F.explode(opened).alias("o")).select("user_id", *[F.col(f"o.x.b.{c}").alias(c) for c in badges.columns], "o.x.earned_at", "o.x.progress", F.col("o.previous").alias(PREVIOUS))
    rows = rows.withColumn("newly_earned", F.col("earned_at").isNull() & (F.col("progress") >= F.col("target")))
    return rows.withColumn("earned", F.col("earned_at").isNotNull() | F.col("newly_earned"))


def _first(name: str, columns: list[str]) -> list[str]:
    return [name, *[c for c in columns if c != name]]


def with_visibility(rows: DataFrame) -> DataFrame:
    """Earned badges show; in a series the next unearned one shows if it is open or follows an earned one; single hidden ones do not."""
    if PREVIOUS in rows.columns:
        rows = rows.withColumnRenamed(PREVIOUS, "_prev")
    else:  # one user's badges lie together already; a series is a handful of them
        rows = rows.withColumn("_prev", F.lag("earned").over(Window.partitionBy("user_id", "series").orderBy("pos")))
    in_series = F.when(F.col("_prev").isNull(), ~F.col("hidden")).otherwise(F.col("_prev"))
    return rows.withColumn("visible", F.col("earned") | F.when(F.col("series").isNotNull(), in_series).otherwise(~F.col("hidden"))).drop("_prev")


def notify_updates(rows: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Mark what to announce: `kind` = earned, progress (at most two per user, nearest to the goal first) or summary.

    `states`: (user_id, code, state_progress, notified_progress, notified_at). On a first check there are no
    progress notes, and more than three new badges become one summary row.
    """
    known = states.select("user_id", F.lit(True).alias("_seen")).unionByName(rows.filter("earned_at IS NOT NULL").select("user_id", F.lit(True).alias("_seen"))).distinct()
    kept = F.struct("state_progress", "notified_progress", "notified_at")
    stored = states.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("code", kept.alias("s")))).alias("_states"))  # at most one per badge
    joined = rows.join(stored, "user_id", "left").withColumn("_s", F.try_element_at("_states", "code")).select(*rows.columns, "_s.*").join(known, "user_id", "left")
    joined = joined.withColumns({"state_progress": F.coalesce("state_progress", F.lit(0)), "notified_progress": F.coalesce("notified_progress", F.lit(0)), "first_check": F.col("_seen").isNull()}).drop("_seen")
    share, before = F.col("progress") / F.col("target"), F.col("notified_progress") / F.col("target")
    crossed = F.lit(False)
    for mark in MILESTONES:
        crossed |= (before < mark) & (share >= mark)
    quiet = F.col("notified_at").isNull() | (F.col("notified_at") <= now - F.expr(f"INTERVAL {QUIET_MINUTES} MINUTE"))
    moved = ~F.col("earned") & F.col("visible") & (F.col("progress") > F.col("state_progress")) & ((F.col("notified_progress") == 0) | crossed | quiet)
    joined = joined.withColumn("_moved", moved)
    place = F.row_number().over(Window.partitionBy("user_id", "_moved").orderBy((F.col("progress") / F.col("target")).desc(), "pos"))  # ≤ one row per badge
    joined = joined.withColumn("notified", F.col("_moved") & (place <= MAX_UPDATES)).drop("_moved")
    return joined.withColumn("kind", F.when(F.col("newly_earned"), "earned").when(F.col("notified") & ~F.col("first_check"), "progress"))


def announcements(rows: DataFrame) -> DataFrame:
    """(user_id, kind, code, progress, target): the messages of one check; many first badges become one summary."""
    said = rows.filter(F.col("kind").isNotNull())
    counts = rows.groupBy("user_id").agg(F.count_if("newly_earned").alias("_n"), F.max("first_check").alias("_first"), one("_all"))
    big = counts.filter(F.col("_first") & (F.col("_n") > FIRST_CHECK_LIMIT))
    summary = big.select("user_id", F.lit("summary").alias("kind"), F.lit("summary").alias("code"), F.col("_n").alias("progress"), F.col("_all").alias("target"))
    return said.join(big, "user_id", "left_anti").select("user_id", "kind", "code", "progress", "target").unionByName(summary)


def state_delta(rows: DataFrame, now: Column) -> DataFrame:
    """State rows to write: changed or announced progress, and everything on a first check."""
    changed = (F.col("progress") != F.col("state_progress")) | F.col("notified") | F.col("first_check")
    return rows.filter(changed).select(
        "user_id", "code", "progress", F.when(F.col("notified"), F.col("progress")).otherwise(F.col("notified_progress")).alias("notified_progress"),
        F.when(F.col("notified"), now).otherwise(F.col("notified_at")).alias("notified_at"),
    )


def badge_list(badges: DataFrame, users: DataFrame, states: DataFrame, earned: DataFrame) -> DataFrame:
    """What a profile shows: stored progress, earned time, share of players holding the badge, secrecy."""
    stored = states.select("user_id", F.col("code"), F.col("state_progress").alias("value"))
    metrics = stored.join(F.broadcast(badges.select("code")), "code").select("user_id", F.col("code").alias("metric"), "value")
    rows = progress(users, badges.withColumn("metric", F.col("code")).withColumn("meta", F.lit(False)), metrics, earned)
    rows = rows.withColumns({"earned": F.col("earned_at").isNotNull(), "progress": F.when(F.col("earned_at").isNotNull(), F.col("target")).otherwise(F.col("progress"))}).drop(PREVIOUS)  # earned means less here
    shown = with_visibility(rows).filter("visible")
    holders = earned.groupBy("code").agg(one("_holders"))
    players = earned.agg(F.count_distinct("user_id").alias("_players"))
    shown = shown.join(holders, "code", "left").join(F.broadcast(players))  # single row
    percent = F.when(F.col("_players") > 0, F.round(F.coalesce("_holders", F.lit(0)) / F.col("_players") * 100, 2)).otherwise(0.0)
    return shown.withColumn("earned_by_percent", percent).withColumn("secret", F.col("hidden") & F.col("series").isNull()).select(
        "user_id", "pos", "code", "progress", "target", "earned", "earned_at", "secret", "earned_by_percent"
    )


def leaderboard(earned: DataFrame, users: DataFrame) -> DataFrame:
    """Most badges first, then who got the last one earlier, then who joined earlier: (rank, user_id, …, total)."""
    scores = earned.groupBy("user_id").agg(one("earned"), F.max("earned_at").alias("last_earned")).join(users, "user_id")
    ranked = enumerate_rows(scores, [F.col("earned").desc(), F.col("last_earned"), F.col("created_at"), F.col("user_id")])
    return ranked.join(F.broadcast(scores.agg(one("total"))))  # single row


def leaderboard_page(ranked: DataFrame, viewer, limit: int = LEADERBOARD_SIZE, offset: int = 0) -> DataFrame:
    """One page plus the viewer's own row wherever it is."""
    mine = F.col("user_id") == viewer
    return ranked.filter(F.col("rank").between(offset + 1, offset + limit) | mine).withColumn("is_me", mine)
