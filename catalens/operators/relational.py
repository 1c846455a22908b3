"""Joins and set operations with bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_bounds(facts: DataFrame, owners: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Facts of each owner inside that owner's own (start, end] interval; `owners` has one row per key."""
    return facts.join(owners, key).filter((F.col(ts) > F.col(start)) & (F.col(ts) <= F.col(end)))


def contained_in(points: DataFrame, spans: DataFrame, keys: list[str], at: Column, start: Column, end: Column, width: int) -> DataFrame:
    """Each point with the spans of the same key covering it.

    `at`, `start` and `end` are whole numbers. Spans are cut into slots of `width`, so the join is an
    equi-join on (key, slot) and a busy key spreads over its slots.
    """
    cut = spans.withColumn("_slot", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))
    return (
        points.withColumn("_slot", F.floor(at / width))
        .join(cut, [*keys, "_slot"])
        .filter((at >= start) & (at <= end))
        .drop("_slot")
    )


def text_join(left: DataFrame, right: DataFrame, left_text: Column, right_text: Column, how: str = "left") -> DataFrame:
    """Join on a normalised text instead of a foreign key."""
    a = left.withColumn("_text", left_text)
    b = right.withColumn("_text", right_text)
    return a.join(b, "_text", how).drop("_text")
