"""Validated ingest: quarantine, upsert, prune, snapshot comparison, schema changes, inventory gaps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.text import blank_to_null
from catalens.functions.values import format_number
from catalens.operators.aggregates import one


@dataclass(frozen=True)
class Rules:
    """What a table must satisfy; applied in this order."""

    required: tuple[str, ...] = ()
    nullable_text: tuple[str, ...] = ()
    casts: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    percent: tuple[str, ...] = ()


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Cleaned columns plus `reasons`, the list of violated rules (empty = valid)."""
    problems: list[Column] = []
    out = df
    for name in rules.nullable_text:
        out = out.withColumn(name, blank_to_null(F.col(name).cast("string")))
    for name in rules.percent:
        number = F.col(name).try_cast("double")
        out = out.withColumn(name, F.when(number.isNotNull(), F.concat(format_number(number), F.lit("%"))).otherwise(blank_to_null(F.col(name))))
    for name in rules.required:
        text = F.col(name).cast("string")
        problems.append(F.when(text.isNull() | (F.length(text) < 1), f"{name}: required"))
    for name, kind in rules.casts.items():
        before = F.col(name)
        problems.append(F.when(before.isNotNull() & before.try_cast(kind).isNull(), f"{name}: not {kind}"))
    for name, (low, high) in rules.ranges.items():
        number = F.col(name).try_cast("double")
        problems.append(F.when(number.isNotNull() & ~number.between(low, high), f"{name}: out of range"))
    reasons = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    out = out.withColumn("reasons", reasons)
    for name, kind in rules.casts.items():
        out = out.withColumn(name, F.col(name).try_cast(kind))
    return out


def validate(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with reasons)."""
    checked = check(df, rules)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of the same key in every column, NULLs included; new keys are added."""
    if set(target.columns) == set(keys):
        return target.unionByName(source.join(target, keys, "left_anti"))
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def prune(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Keep target rows whose key, compared as text, is still in the source."""
    names = [f"_k{i}" for i in range(len(keys))]
    wanted = source.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)])
    condition = [F.col(k).cast("string") == F.col(n) for k, n in zip(keys, names)]
    return target.join(wanted, condition, "left_semi")


def snapshot_diff(current: DataFrame, wanted: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """keep / add / delete per key; only wanted rows of known parents count; kept rows stay as they are."""
    wanted = wanted.join(parents, parent, "left_semi")
    a, b = current.alias("a"), wanted.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    action = F.when(F.col(f"b.{key}").isNull(), "delete").when(F.col(f"a.{key}").isNull(), "add").otherwise("keep")
    return joined.select(
        action.alias("action"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in current.columns]
    )


def conform(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Bring a table to `schema` (name → type, default): missing columns added, changed types cast. Repeatable."""
    columns = []
    for name, (kind, default) in schema.items():
        base = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        columns.append((base if default is None else F.coalesce(base, F.lit(default).cast(kind))).alias(name))
    return df.select(*columns)


def inventory_gaps(table: DataFrame, files: DataFrame, keys: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(found and missing counts per kind, missing rows)."""
    present = files.select(*keys).distinct().withColumn("_here", F.lit(1))
    marked = table.join(present, keys, "left")
    counts = marked.groupBy(kind).agg(F.count("_here").alias("found"), (one() - F.count("_here")).alias("missing"))
    return counts, marked.filter(F.col("_here").isNull()).drop("_here")
