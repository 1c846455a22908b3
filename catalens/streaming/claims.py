"""Anonymous searches: claimed by the next login within the time limit, expired after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.operators.activity import ANONYMOUS_HOURS
from catalens.streaming.jobs import use_rocksdb


def claim_and_expire_stream(history: DataFrame, logins: DataFrame, delay: str, ttl_hours: int = ANONYMOUS_HOURS) -> DataFrame:
    """Anonymous searches (search_id, anon_id, created_at) with the logins (anon_id, login_user, login_at) that follow in time.

    A left outer interval join: a search matches each login within the limit; one that has none comes out, with nulls, when the
    watermark has passed its limit, and that is its expiry. Both sides are forgotten at that time. Many logins give many rows; `outcomes` keeps the first.
    """
    use_rocksdb(history.sparkSession)
    left = history.filter("user_id IS NULL AND anon_id IS NOT NULL").select("search_id", "anon_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", delay)
    right = logins.filter("anon_id IS NOT NULL").select(F.col("anon_id").alias("login_anon"), "login_user", F.col("login_at").cast("timestamp").alias("login_at")).withWatermark("login_at", delay)
    near = (F.col("anon_id") == F.col("login_anon")) & (F.col("login_at") >= F.col("created_at")) & (F.col("login_at") <= F.col("created_at") + F.expr(f"INTERVAL {ttl_hours} HOURS"))
    return left.join(right, near, "left_outer").select("search_id", "login_user", "login_at")


def outcomes(written: DataFrame) -> DataFrame:
    """(search_id, user_id, login_at, expired) per decided search: the first login claims, no login is expiry."""
    first = written.groupBy("search_id").agg(F.min_by(F.struct("login_user", "login_at"), F.struct(F.col("login_at").isNull(), "login_at", "login_user")).alias("r"))
    return first.select("search_id", F.col("r.login_user").alias("user_id"), "r.login_at", F.col("r.login_user").isNull().alias("expired"))


def settled_history(history: DataFrame, decided: DataFrame) -> DataFrame:
    """The history table once the outcomes are applied: claimed searches change hands, expired ones are gone, open ones stay anonymous."""
    known = decided.select("search_id", F.col("user_id").alias("_user"), "expired")
    rows = history.join(known, "search_id", "left").filter("expired IS NULL OR NOT expired")
    claimed = F.col("_user").isNotNull()
    return rows.withColumns({"user_id": F.coalesce("user_id", "_user"), "anon_id": F.when(~claimed, F.col("anon_id"))}).drop("_user", "expired")
