"""Grouping, ranking and top-k building blocks that stay balanced when one key holds many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import materialize


def one(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def document_frequency(df: DataFrame, toks: str, out: str) -> DataFrame:
    """Per token the number of rows holding it, and the number of rows: (token, df, n)."""
    rows = df.groupBy().agg(one("n"))
    freq = df.select(F.explode(F.array_distinct(toks)).alias(out)).groupBy(out).agg(one("df"))
    return freq.join(F.broadcast(rows))  # the right side is a single row


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key; equal times keep the smallest tie value. Map-side combined, no window."""
    order = F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("t"), F.col(tie).alias("i"))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by ascending `order`. Map-side combined."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def longest_streak(df: DataFrame, user: str, day: str) -> DataFrame:
    """Longest run of consecutive days per user (days are made distinct first, so a user stays small)."""
    days = df.select(user, F.col(day).alias("_d")).filter(F.col("_d").isNotNull()).distinct()
    island = F.date_sub("_d", F.row_number().over(Window.partitionBy(user).orderBy("_d")))
    runs = days.withColumn("_g", island).groupBy(user, "_g").agg(one("_n"))
    return runs.groupBy(user).agg(F.max("_n").alias("longest_streak"))


def busiest_day(df: DataFrame, user: str, day: str, item: str) -> DataFrame:
    per_day = df.groupBy(user, day).agg(F.count_distinct(item).alias("_n"))
    return per_day.groupBy(user).agg(F.max("_n").alias("most_items_in_a_day"))


def sessions(df: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Runs of activity closed by more than `gap_seconds` of silence: (user, start, end, n).

    Events of one gap-long time slot always share a session, so they are combined per slot before
    the ordered pass; that pass sees at most one row per user and slot.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(micros / (gap_seconds * 1_000_000))
    slots = (
        df.select(user, F.col(ts).alias("_ts"), slot.alias("_slot"), micros.alias("_m"))
        .groupBy(user, "_slot")
        .agg(F.min("_ts").alias("_lo"), F.max("_ts").alias("_hi"), F.min("_m").alias("_mlo"), F.max("_m").alias("_mhi"), one("_n"))
    )
    w = Window.partitionBy(user).orderBy("_slot")
    fresh = F.coalesce((F.col("_mlo") - F.lag("_mhi").over(w)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = slots.withColumn("_new", fresh.cast("int")).withColumn("_s", F.sum("_new").over(w))
    return numbered.groupBy(user, "_s").agg(
        F.min("_lo").alias("session_start"), F.max("_hi").alias("session_end"), F.sum("_n").alias("n")
    ).drop("_s")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best `k` rows per key; Spark limits each group before the shuffle as well as after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def enumerate_rows(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Sequential rank 1..n over the whole table in a total order.

    Rows are range-partitioned by the order, stored with their partition number, numbered inside each
    range and shifted by the rows before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(one("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn(rank, inside)
        .join(F.broadcast(offsets), "_range")  # one row per range
        .withColumn(rank, (F.col(rank) + F.col("_offset")).cast("long"))
        .drop("_range", "_offset")
    )


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def exact_quantiles_of(df: DataFrame, groups: list[str], wanted: dict[str, tuple[str, float, bool]], accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles of any number of columns per group without gathering a group in one task.

    `wanted`: name → (column, share, interpolate); nearest rank where not interpolated. Two passes over the rows, however many columns: a sketch
    brackets each wanted rank, then only values inside the brackets are counted one by one, those below a bracket just add to its
    offset. NULLs don't count; a group key may be NULL; a group without any value has no row.
    """
    names, columns, step = list(wanted), list(dict.fromkeys(c for c, _, _ in wanted.values())), 2.0 / accuracy
    data = df.select(F.struct(*groups).alias("_g") if groups else F.lit(0).alias("_g"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    per_column = []
    for i, column in enumerate(columns):
        x, shares = F.col("_x")[i], [p for c, p, _ in wanted.values() if c == column]
        cuts = [max(0.0, p - step) for p in shares] + [min(1.0, p + step) for p in shares]
        per_column.append(F.struct(F.count(x).alias("n"), F.percentile_approx(x, cuts, accuracy).alias("cut"), F.min(x).alias("min"), F.max(x).alias("max")).alias(f"_s{i}"))
    sketch = data.groupBy("_g").agg(*per_column)
    brackets, seen = [], dict.fromkeys(columns, 0)
    for q, (column, p, interpolate) in wanted.items():
        s, at, many = F.col(f"_s{columns.index(column)}"), seen[column], sum(c == column for c, _, _ in wanted.values())
        seen[column] += 1
        if interpolate:
            pos = (s["n"] - 1) * p
            low, high = F.floor(pos) + 1, F.ceil(pos) + 1
        else:
            pos = low = high = F.greatest(F.ceil(s["n"] * p - 1e-9), F.lit(1))
        lo = s["min"] if p - step <= 0 else s["cut"][at]
        hi = s["max"] if p + step >= 1 else s["cut"][at + many]
        brackets.append(F.struct(F.lit(q).alias("q"), F.lit(columns.index(column)).alias("c"), low.cast("long").alias("r1"), high.cast("long").alias("r2"),
                                 (pos - F.floor(pos)).cast("double").alias("f"), lo.alias("lo"), hi.alias("hi")))
    ranks = sketch.select("_g", F.filter(F.array(*brackets), lambda b: b["lo"].isNotNull()).alias("_b"))
    joined = data.join(ranks if groups else F.broadcast(ranks), "_g")  # without groups a single row
    # one row per wanted quantile: below the bracket the value is dropped and only counted
    value = lambda b: F.get(F.col("_x"), b["c"])
    inside = F.transform(F.filter("_b", lambda b: value(b) <= b["hi"]), lambda b: F.struct(*[b[c].alias(c) for c in ("q", "r1", "r2", "f")], F.when(value(b) >= b["lo"], value(b)).alias("v")))
    counted = joined.select("_g", F.explode(inside).alias("_h")).select("_g", "_h.*").groupBy("_g", "q", "r1", "r2", "f", "v").agg(one("_c"))  # ranks depend on q
    w = Window.partitionBy("_g", "q").orderBy(F.col("v").asc_nulls_first())
    picked = counted.withColumn("_upto", F.sum("_c").over(w)).filter(F.col("v").isNotNull())

    def at_rank(rank: str) -> Column:
        return F.min(F.when(F.col("_upto") >= F.col(rank), F.col("v")))

    per = picked.groupBy("_g", "q").agg(at_rank("r1").alias("_a"), at_rank("r2").alias("_z"), F.first("f").alias("_f"))
    per = per.withColumn("_value", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f"))
    out = per.groupBy(*["_g"] * bool(groups)).agg(*[F.max(F.when(F.col("q") == q, F.col("_value"))).alias(q) for q in names])
    return out.select("_g.*", *names) if groups else out


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], interpolate: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Exact quantiles of one column per group, see `exact_quantiles_of`."""
    return exact_quantiles_of(df, groups, {name: (value, p, interpolate) for name, p in quantiles.items()}, accuracy)


def mean_of_best(df: DataFrame, keys: list[str], score: str, n: int, out: str) -> DataFrame:
    """Mean of the `n` best scores per key."""
    return top_k(df, keys, [F.col(score).desc()], n, "_r").groupBy(*keys).agg(F.avg(score).alias(out))


def rating_summary(df: DataFrame, keys: list[str], rating: str) -> DataFrame:
    """Count, rated count, average (2 decimals, 0 and NULL are unrated) and the counts of 1..5."""
    rated = F.when(F.col(rating) > 0, F.col(rating))
    return df.groupBy(*keys).agg(
        one("reviews"), F.count(rated).alias("rated"), F.round(F.avg(rated), 2).alias("average"),
        *[F.count_if(F.col(rating) == star).alias(f"stars_{star}") for star in range(1, 6)],
    )
