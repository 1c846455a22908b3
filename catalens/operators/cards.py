"""Denormalised item cards, filters and photo-view decisions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.operators.aggregates import one

# --- fixed values ----------------------------------------------------------------------------------
MIN_CONFIDENCE = 0.25
MARGIN = 0.04
LABEL_SCORE = (0.35, 0.45, 0.20)
BOTTLE_SCORE = (0.30, 0.45, 0.25)
REGION_SCORE = 0.25
LABEL_PHOTO_AREA, LABEL_PHOTO_CONFIDENCE = 0.60, 0.50
MANY_LABELS = 3
VIEWS = ("original", "bottle_crop", "label_crop")
UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
# ----------------------------------------------------------------------------------------------------


def name_lists(links: DataFrame, names: DataFrame, item: str, key: str, name: str, out: str) -> DataFrame:
    """Sorted distinct linked names per item; duplicates vanish before the lists form."""
    pairs = links.select(item, key).distinct().join(names, key)
    return pairs.groupBy(item).agg(F.array_sort(F.collect_set(name)).alias(out))


def photo_facts(photos: DataFrame, item: str) -> DataFrame:
    """Counts of real and generated photos per item and the first real one: main first, then by path."""
    real = ~F.col("is_generated")
    return photos.groupBy(item).agg(
        F.count_if(real).alias("real_photos"), F.count_if(~real).alias("generated_photos"),
        F.min_by(F.when(real, F.col("path")), F.when(real, F.struct(~F.col("is_main"), F.col("path")))).alias("image_url"),
    )


def item_cards(items: DataFrame, item: str, dimensions: list[tuple[DataFrame, str]], lists: list[DataFrame]) -> DataFrame:
    """Items left-joined with nullable dimensions (frame, key) and per-item list or fact frames."""
    for frame, key in dimensions:
        items = items.join(frame, key, "left")
    for frame in lists:
        items = items.join(frame, item, "left")
    return items


def by_ids(cards: DataFrame, ids: DataFrame, key: str, uuid_only: bool = True) -> DataFrame:
    """Cards of the listed ids; repeated ids count once, ids that are no UUID are ignored."""
    wanted = ids.select(F.col(key).cast("string").alias(key)).distinct()
    if uuid_only:
        wanted = wanted.filter(F.col(key).rlike(UUID_PATTERN))
    return cards.join(wanted, key, "left_semi")


def evidence_slice(ids: DataFrame, cards: DataFrame, key: str, columns: list[str], producer: str, placeholder: str) -> DataFrame:
    """Only the columns text matching needs; the placeholder producer is NULL, a missing card is all NULL."""
    slim = cards.select(key, *columns).withColumn(producer, F.when(F.col(producer) != placeholder, F.col(producer)))
    return ids.join(slim, key, "left")


@dataclass(frozen=True)
class Filters:
    """Selected values per dimension; empty = no filter."""

    all_of: dict[str, list[str]] = field(default_factory=dict)
    one_of: dict[str, list[str]] = field(default_factory=dict)
    any_of: dict[str, list[str]] = field(default_factory=dict)
    min_rating: float | None = None


def passes(spec: Filters, skip: str | None = None, rating: str = "rating") -> Column:
    """AND over dimensions: array holds all, value is one of, array overlaps, rating ≥ minimum (NULL = 0)."""
    result = F.lit(True)
    for name, chosen in spec.all_of.items():
        if chosen and name != skip:
            result &= F.size(F.array_except(F.array(*[F.lit(v) for v in chosen]), F.col(name))) == 0
    for name, chosen in spec.one_of.items():
        if chosen and name != skip:
            result &= F.coalesce(F.col(name).isin(chosen), F.lit(False))
    for name, chosen in spec.any_of.items():
        if chosen and name != skip:
            result &= F.coalesce(F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in chosen])), F.lit(False))
    if spec.min_rating is not None and skip != "rating":
        result &= F.coalesce(F.col(rating), F.lit(0.0)) >= spec.min_rating
    return result


def map_groups(df: DataFrame, column: str, groups: DataFrame, out: str) -> DataFrame:
    """Raw value → its group; values without a group pass through. `groups`: (raw, grp)."""
    mapped = df.join(groups, F.col(column) == F.col("raw"), "left")
    return mapped.withColumn(out, F.coalesce("grp", column)).drop("raw", "grp")


def first_match(text: Column, pattern: str) -> Column:
    """First regex match as the reason, NULL without one."""
    hit = F.regexp_extract(text, f"({pattern})", 1)
    return F.when(hit != "", hit)


def best_box(boxes: DataFrame, photo: str, weights: tuple[float, float, float], tie: list[str], region: bool = False) -> DataFrame:
    """The winning detection per photo, widened by a margin.

    `boxes`: photo, x1, y1, x2, y2, confidence, frame_w, frame_h and, with `region`, rx1..ry2 (NULL = none).
    """
    valid = boxes.filter(F.col("confidence") >= MIN_CONFIDENCE)
    w, h = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    valid = valid.withColumn("_w", w).withColumn("_h", h).withColumn("_area", w * h)
    largest = valid.groupBy(photo).agg(F.max("_area").alias("_max"), one("candidates")).filter("_max > 0")
    half = F.col("frame_w") / 2
    centre = F.least(F.greatest(1.0 - F.abs((F.col("x1") + F.col("_w") / 2 - half) / F.greatest(half, F.lit(1.0))), F.lit(0.0)), F.lit(1.0))
    score = weights[0] * F.col("confidence") + weights[1] * centre + weights[2] * F.col("_area") / F.col("_max")
    if region:
        iw = F.greatest(F.lit(0.0), F.least("x2", "rx2") - F.greatest("x1", "rx1"))
        ih = F.greatest(F.lit(0.0), F.least("y2", "ry2") - F.greatest("y1", "ry1"))
        cover = iw * ih / F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
        score = score + F.when(F.col("rx1").isNull(), 0.0).otherwise(REGION_SCORE * cover)
    scored = valid.join(largest, photo).withColumn("_score", score)
    best = scored.groupBy(photo).agg(
        F.min_by(F.struct("x1", "y1", "x2", "y2", "confidence", "frame_w", "frame_h", "candidates"), F.struct(-F.col("_score"), *tie)).alias("b")
    ).select(photo, "b.*")
    margin = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * MARGIN
    cut = best.select(
        photo, "confidence", "candidates",
        F.greatest(F.lit(0), (F.col("x1") - margin).cast("int")).alias("x1"), F.greatest(F.lit(0), (F.col("y1") - margin).cast("int")).alias("y1"),
        F.least(F.col("frame_w").cast("int"), (F.col("x2") + margin).cast("int")).alias("x2"),
        F.least(F.col("frame_h").cast("int"), (F.col("y2") + margin).cast("int")).alias("y2"),
    )
    return cut.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def crop_provenance(photos: DataFrame, detections: DataFrame, photo: str, tie: list[str]) -> DataFrame:
    """Where each photo's crops come from.

    Bottle on the frame; label on the frame (preferring the bottle); else label inside the bottle; else
    the whole frame stands in. `detections` carries kind (bottle/label) and source (original/bottle_crop).
    """
    pick = lambda kind, source: detections.filter((F.col("kind") == kind) & (F.col("source") == source))
    bottle = best_box(pick("bottle", "original"), photo, BOTTLE_SCORE, tie)
    region = bottle.select(photo, *[F.col(c).cast("double").alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")])
    framed = best_box(pick("label", "original").join(region, photo, "left"), photo, LABEL_SCORE, tie, region=True)
    inside = pick("label", "bottle_crop").join(region, photo)
    inside = inside.withColumn("frame_w", F.col("rx2") - F.col("rx1")).withColumn("frame_h", F.col("ry2") - F.col("ry1"))
    inner = best_box(inside, photo, LABEL_SCORE, tie)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(photo, *[F.col(c).alias(f"{prefix}_{c}") for c in ("x1", "y1", "x2", "y2", "confidence", "candidates")])

    rows = photos.join(named(bottle, "bottle"), photo, "left").join(named(framed, "framed"), photo, "left").join(named(inner, "inner"), photo, "left")
    on_frame, in_bottle = F.col("framed_x1").isNotNull(), F.col("inner_x1").isNotNull()
    whole = {"x1": F.lit(0), "y1": F.lit(0), "x2": F.col("frame_w").cast("int"), "y2": F.col("frame_h").cast("int"), "confidence": F.lit(1.0)}
    label = [F.when(on_frame, F.col(f"framed_{c}")).when(in_bottle, F.col(f"inner_{c}")).otherwise(v).alias(f"label_{c}") for c, v in whole.items()]
    return rows.select(
        photo, "frame_w", "frame_h", F.col("bottle_x1").isNotNull().alias("has_bottle"), *[f"bottle_{c}" for c in whole],
        F.when(on_frame, "original").when(in_bottle, "bottle_crop").otherwise("original_fallback").alias("label_source"), *label,
        F.coalesce("bottle_candidates", F.lit(0)).alias("bottles"), F.when(on_frame, F.col("framed_candidates")).otherwise(0).alias("labels"),
    )


def select_views(crops: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Which views to search with, from `crop_provenance` rows."""
    names = [v for v in VIEWS if allowed is None or v in allowed]
    has = {"original": F.lit(True), "bottle_crop": F.col("has_bottle"), "label_crop": F.lit(True)}
    active = F.array_compact(F.array(*[F.when(has[v], v) for v in names]))
    on_frame = F.col("label_source") == "original"
    area = F.greatest(F.lit(0), F.col("label_x2") - F.col("label_x1")) * F.greatest(F.lit(0), F.col("label_y2") - F.col("label_y1"))
    ratio = F.when(on_frame, area / F.greatest(F.lit(1), (F.col("frame_w") * F.col("frame_h")).cast("long"))).otherwise(0.0)
    close_up = on_frame & (F.col("_ratio") > LABEL_PHOTO_AREA) & (F.col("label_confidence") > LABEL_PHOTO_CONFIDENCE)
    many = F.col("labels") >= MANY_LABELS
    out = crops.withColumn("_ratio", ratio).withColumn("_v", active)
    out = out.withColumn("_v", F.when((F.col("label_source") == "original_fallback") & (F.size("_v") > 1), F.array_remove("_v", "label_crop")).otherwise(F.col("_v")))
    out = out.withColumn("_v", F.when(close_up & F.array_contains("_v", "label_crop"), F.array(F.lit("label_crop"))).otherwise(F.col("_v")))
    if allowed is None:
        out = out.withColumn("_v", F.when(many & (F.size("_v") > 1), F.array_remove("_v", "original")).otherwise(F.col("_v")))
    return out.withColumn("label_area_ratio", F.col("_ratio")).withColumn("label_photo", close_up).withColumn("many_labels", many).withColumn("views", F.col("_v")).drop("_ratio", "_v")


def text_source_view(available: Column) -> Column:
    """The crop to read text from, of an array of available views: label, else bottle, else the frame."""
    return F.coalesce(*[F.when(F.array_contains(available, view), view) for view in ("label_crop", "bottle_crop")], F.lit("original"))


def status(candidates: Column) -> Column:
    return F.when(candidates > 0, "found").otherwise("not_found")
