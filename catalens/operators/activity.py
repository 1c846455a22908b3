"""User activity: change logs, history, favourites, reviews, reactions, reminders. All users in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions.values import review_frame
from catalens.operators.aggregates import latest_per_key, one, rating_summary, top_k

# --- fixed values ----------------------------------------------------------------------------------
HISTORY_RESULTS = 10
ANONYMOUS_HOURS = 72
REMINDER_QUIET_MINUTES, REMINDER_WINDOW_HOURS = 60, 24
MAX_REVIEW_PHOTOS, MAX_COMMENT = 5, 2000
REVIEWS_SHOWN, BATCH = 50, 200
PERIOD_MINUTES = (1, 43200)
# ----------------------------------------------------------------------------------------------------


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} MINUTE")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOUR")


def taken_names(users: DataFrame, user: str, name: str, out: str) -> DataFrame:
    """True where another user holds the same name, ignoring case."""
    counts = users.groupBy(F.lower(name).alias("_name")).agg(one("_holders"))
    return users.withColumn("_name", F.lower(name)).join(counts, "_name", "left").withColumn(out, F.col("_holders") > 1).drop("_name", "_holders")


def assign_nicknames(users: DataFrame, user: str, name: str, prefix: str) -> DataFrame:
    """Fill missing names with unique `prefix-<digits>`, the same on every run and not derived from e-mail.

    Users whose hashed number collides get the number of their turn appended; taken names are avoided
    by a longer suffix made of the user id itself.
    """
    named, bare = users.filter(F.col(name).isNotNull()), users.filter(F.col(name).isNull())
    digits = F.lpad(F.pmod(F.xxhash64(F.col(user), F.lit("nickname")), F.lit(100_000_000)).cast("string"), 8, "0")
    first = bare.withColumn("_base", F.concat(F.lit(f"{prefix}-"), digits))
    turn = F.row_number().over(Window.partitionBy("_base").orderBy(user))
    first = first.withColumn("_turn", turn).withColumn("_try", F.when(F.col("_turn") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_turn").cast("string"))))
    used = named.select(F.lower(name).alias("_try"), F.lit(True).alias("_used")).distinct()
    first = first.withColumn("_low", F.lower("_try")).join(used.withColumnRenamed("_try", "_low"), "_low", "left")
    given = F.when(F.col("_used").isNull(), F.col("_try")).otherwise(F.concat(F.lit(f"{prefix}-"), F.col(user).cast("string"), F.lit("-"), digits))
    return named.unionByName(first.withColumn(name, given).select(*users.columns))


# --- change logs ------------------------------------------------------------------------------------
def apply_changes(state: DataFrame, changes: DataFrame, keys: list[str], payload: list[str], policy: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """Apply a change log to a state table of (keys, payload, created_at, updated_at).

    `changes`: keys, payload, op ('put' or 'delete'), ts, seq. Policies: `upsert` takes the newest
    payload and keeps created_at; `insert_ignore` keeps what is there. A delete forgets all before it. An upsert
    that leaves a `sticky` column empty keeps its value.
    """
    order = F.struct("ts", "seq")
    reduced = changes.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "delete", order)).alias("_gone"), F.max(F.when(F.col("op") == "put", order)).alias("_last")
    )
    puts = changes.filter(F.col("op") == "put").join(reduced, keys).filter(F.col("_gone").isNull() | (order > F.col("_gone")))
    pick = (F.max_by if policy == "upsert" else F.min_by)(F.struct(*payload), order)
    given = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_s_{c}") for c in sticky]
    fresh = puts.groupBy(*keys).agg(pick.alias("_p"), F.min("ts").alias("_from"), F.max("ts").alias("_to"), *given)
    deleted = reduced.filter(F.col("_gone").isNotNull()).select(*keys)
    kept = state.join(deleted, keys, "left_anti")
    old = kept.select(*keys, F.struct(*payload).alias("_op"), "created_at", "updated_at", F.lit(True).alias("_old"))
    both = old.join(fresh, keys, "full")
    if policy == "upsert":
        row, until = F.coalesce("_p", "_op"), F.coalesce("_to", "updated_at")
        for c in sticky:
            row = row.withField(c, F.coalesce(f"_s_{c}", F.col("_op")[c]))
    else:
        row, until = F.coalesce("_op", "_p"), F.coalesce("updated_at", "_from")
    return both.select(*keys, row.alias("_r"), F.coalesce("created_at", "_from").alias("created_at"), until.alias("updated_at")).select(*keys, "_r.*", "created_at", "updated_at")


def update_where(state: DataFrame, changes: DataFrame, keys: list[str], ts: str, flag: str) -> DataFrame:
    """Set a timestamp flag, once, on rows named by the changes."""
    first = changes.groupBy(*keys).agg(F.min(ts).alias("_at"))
    return state.join(first, keys, "left").withColumn(flag, F.coalesce(flag, "_at")).drop("_at")


def delete_cascade(parents: DataFrame, children: DataFrame, removed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return parents.join(removed, key, "left_anti"), children.join(removed, key, "left_anti")


# --- history ----------------------------------------------------------------------------------------
def record_searches(searches: DataFrame, items: DataFrame) -> DataFrame:
    """(search_id, user_id, anon_id, created_at, results array<struct<item,score>>, confidence, source) → history rows."""
    owned = searches.filter(F.col("user_id").isNotNull() | F.col("anon_id").isNotNull())
    refs = F.transform(F.slice("results", 1, HISTORY_RESULTS), lambda r: F.struct(r["item"].alias("item"), F.round(r["score"], 6).alias("score")))
    rows = owned.select(
        "search_id", "user_id", F.when(F.col("user_id").isNull(), F.col("anon_id")).alias("anon_id"), "created_at", refs.alias("results"),
        F.get("results", F.lit(0))["item"].alias("_top"), "confidence", (F.col("source") == "camera").alias("from_camera"),
    )
    known = items.select(F.col("item").alias("_top"), F.col("item").alias("top_item")).distinct()
    return rows.join(known, "_top", "left").drop("_top")


def claim_anonymous(history: DataFrame, logins: DataFrame, ttl_hours: int = ANONYMOUS_HOURS) -> DataFrame:
    """Anonymous rows within the time limit before a login move to the account. `logins`: (anon_id, login_user, login_at), one per id."""
    joined = history.join(logins, "anon_id", "left")
    mine = F.col("login_user").isNotNull() & F.col("user_id").isNull() & (F.col("created_at") <= F.col("login_at")) & (F.col("created_at") >= F.col("login_at") - hours(ttl_hours))
    mine = F.coalesce(mine, F.lit(False))
    moved = joined.withColumns({"user_id": F.when(mine, F.col("login_user")).otherwise(F.col("user_id")), "anon_id": F.when(~mine, F.col("anon_id"))})
    return moved.drop("login_user", "login_at")


def expire_anonymous(history: DataFrame, now: Column, ttl_hours: int = ANONYMOUS_HOURS) -> DataFrame:
    return history.filter(F.col("user_id").isNotNull() | (F.col("created_at") >= now - hours(ttl_hours)))


def history_pages(history: DataFrame, now: Column, limit: int, offset: int = 0) -> DataFrame:
    """Newest rows first per owner, with the owner's total; anonymous rows only within the time limit."""
    rows = expire_anonymous(history, now).withColumn("owner", F.coalesce(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("anon:"), F.col("anon_id"))))
    rows = rows.filter(F.col("owner").isNotNull())
    totals = rows.groupBy("owner").agg(one("total"))
    page = top_k(rows, ["owner"], [F.col("created_at").desc(), F.col("search_id")], offset + limit, "position").filter(F.col("position") > offset)
    return page.join(totals, "owner")


def viewed_items(history: DataFrame, items: DataFrame, favorites: DataFrame, reviews: DataFrame, since: Column, until: Column) -> DataFrame:
    """Latest view per (user, item) within inclusive bounds; a card is required; favourite flag and own rating attached."""
    recent = history.filter(F.col("user_id").isNotNull() & F.col("item").isNotNull() & F.col("created_at").between(since, until))
    latest = latest_per_key(recent.select("user_id", "item", "created_at", "search_id"), ["user_id", "item"], "created_at", "search_id")
    shown = latest.join(items.select("item"), "item", "left_semi")
    liked = favorites.select("user_id", "item", F.lit(True).alias("is_favorite")).distinct()
    return shown.join(liked, ["user_id", "item"], "left").withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False))).join(
        reviews.select("user_id", "item", "rating"), ["user_id", "item"], "left"
    )


def favorites_page(favorites: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    return top_k(favorites.join(items, "item"), ["user_id"], [F.col("created_at").desc(), F.col("item")], limit, "position")


# --- reviews ----------------------------------------------------------------------------------------
def reaction_counts(reactions: DataFrame, keys: list[str]) -> DataFrame:
    return reactions.groupBy(*keys).agg(F.count_if(F.col("value") == 1).alias("likes"), F.count_if(F.col("value") == -1).alias("dislikes"))


def review_summaries(reviews: DataFrame) -> DataFrame:
    return rating_summary(reviews, ["item"], "rating")


def review_feed(reviews: DataFrame, reactions: DataFrame, viewer, limit: int = REVIEWS_SHOWN) -> DataFrame:
    """Feed of every item: own review first, then newest; author counts, frame, likes and own reaction."""
    authors = reviews.groupBy("user_id").agg(F.count("comment").alias("author_comments"), one("author_reviews"))
    own = reactions.filter(F.col("reactor") == viewer).select("user_id", "item", F.col("value").alias("my_reaction"))
    rows = top_k(reviews.withColumn("is_mine", F.col("user_id") == viewer), ["item"], [~F.col("is_mine"), F.col("updated_at").desc(), F.col("user_id")], limit, "position")
    rows = rows.join(authors, "user_id").join(reaction_counts(reactions, ["user_id", "item"]), ["user_id", "item"], "left").join(own, ["user_id", "item"], "left")
    return rows.withColumns({"likes": F.coalesce("likes", F.lit(0)), "dislikes": F.coalesce("dislikes", F.lit(0)), "author_frame": review_frame(F.col("author_comments"))})


def my_reviews(reviews: DataFrame, reactions: DataFrame, items: DataFrame) -> DataFrame:
    """Every user's own reviews with reactions; items without a card are left out. Newest first by updated_at."""
    counts = reaction_counts(reactions, ["user_id", "item"])
    rows = reviews.join(items.select("item"), "item", "left_semi").join(counts, ["user_id", "item"], "left")
    return rows.withColumns({"likes": F.coalesce("likes", F.lit(0)), "dislikes": F.coalesce("dislikes", F.lit(0))})


def review_photos(photos: DataFrame, reviews: DataFrame) -> DataFrame:
    """Photos of existing reviews, numbered in upload order. The first MAX_REVIEW_PHOTOS stay; later ones are over the cap, as a refused upload is."""
    kept = photos.join(reviews.select("user_id", "item"), ["user_id", "item"], "left_semi")
    counts = kept.groupBy("user_id", "item").agg(one("photos"))
    place = F.row_number().over(Window.partitionBy("user_id", "item").orderBy("created_at", "photo"))
    rows = kept.withColumn("position", place.cast("long")).join(counts, ["user_id", "item"])
    return rows.withColumn("over_cap", F.col("position") > MAX_REVIEW_PHOTOS)


def check_reviews(reviews: DataFrame, notifications: DataFrame) -> DataFrame:
    """Trim comments, drop foreign notification links, list what is wrong."""
    comment = F.trim("comment")
    owned = notifications.select("notification_id", F.col("user_id").alias("_owner"))
    rows = reviews.withColumn("comment", F.when(comment != "", comment)).join(owned, "notification_id", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("rating").isNull() & F.col("comment").isNull(), "rating or comment required"),
        F.when(F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), "rating out of range"), F.when(F.length("comment") > MAX_COMMENT, "comment too long"),
    ))
    return rows.withColumn("notification_id", F.when(F.col("_owner") == F.col("user_id"), F.col("notification_id"))).withColumn("problems", problems).drop("_owner")


def valid_reactions(reactions: DataFrame, reviews: DataFrame) -> DataFrame:
    """No reaction to oneself, none to a review without a comment."""
    commented = reviews.filter(F.col("comment").isNotNull()).select("user_id", "item")
    return reactions.filter(F.col("reactor") != F.col("user_id")).join(commented, ["user_id", "item"], "left_semi")


# --- notifications ----------------------------------------------------------------------------------
def due_users(history: DataFrame, now: Column, quiet: int = REMINDER_QUIET_MINUTES) -> DataFrame:
    open_ = history.filter(F.col("user_id").isNotNull() & F.col("notified_at").isNull())
    return open_.groupBy("user_id").agg(F.max("created_at").alias("last_search")).filter(F.col("last_search") <= now - minutes(quiet))


def reminders(history: DataFrame, favorites: DataFrame, reviews: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notifications, their items, processed searches) for users whose session has ended.

    All open searches of a due user are processed; only items viewed in the last day, neither
    favourite nor reviewed, are announced. No notification without items.
    """
    due = due_users(history, now)
    open_ = history.filter(F.col("notified_at").isNull()).join(due.select("user_id"), "user_id", "left_semi")
    recent = open_.filter(F.col("item").isNotNull() & (F.col("created_at") >= now - hours(REMINDER_WINDOW_HOURS)))
    views = latest_per_key(recent.select("user_id", "item", "created_at", "search_id"), ["user_id", "item"], "created_at", "search_id")
    handled = favorites.select("user_id", "item").unionByName(reviews.select("user_id", "item")).distinct()
    items = views.join(handled, ["user_id", "item"], "left_anti").withColumnRenamed("created_at", "viewed_at")
    notes = items.groupBy("user_id").agg(one("items"), F.min("viewed_at").alias("period_start"), F.max("viewed_at").alias("period_end"))
    return notes, items, open_.select("search_id", "user_id")


def reaction_digest(users: DataFrame, reactions: DataFrame, now: Column, batch: int | None = None) -> DataFrame:
    """Due authors with the number of distinct reactors since their last digest; the marker moves even for zero.

    `users`: (user_id, period_minutes, notified_at). Never-notified users come first; a worker that runs
    often may take a `batch` of authors at a time.
    """
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.col("period_minutes"))
    due = users.filter((F.col("period_minutes") > 0) & (F.col("notified_at").isNull() | (F.col("notified_at") <= now - span)))
    if batch is not None:
        due = due.orderBy(F.col("notified_at").asc_nulls_first(), "user_id").limit(batch)
    due = due.withColumn("period_start", F.coalesce("notified_at", now - span)).withColumn("period_end", now)
    hits = reactions.join(due.select("user_id", "period_start", "period_end"), "user_id")
    hits = hits.filter((F.col("updated_at") > F.col("period_start")) & (F.col("updated_at") <= F.col("period_end")))
    counts = hits.groupBy("user_id").agg(F.count_distinct("reactor").alias("reactors"))
    return due.join(counts, "user_id", "left").withColumn("reactors", F.coalesce("reactors", F.lit(0))).select("user_id", "period_start", "period_end", "reactors")


def notification_pages(notes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first per user with total and unread counts."""
    totals = notes.groupBy("user_id").agg(one("total"), F.count_if(F.col("read_at").isNull()).alias("unread"))
    page = top_k(notes, ["user_id"], [F.col("created_at").desc(), F.col("notification_id")], offset + limit, "position").filter(F.col("position") > offset)
    return page.join(totals, "user_id")


def valid_period(period: Column) -> Column:
    return period.between(*PERIOD_MINUTES)
