"""Request-log analytics over JSON-lines events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.operators.aggregates import exact_quantiles

# --- fixed values ----------------------------------------------------------------------------------
SLOW_MS = 5000
QUIET_METHODS = ("OPTIONS", "HEAD")
QUIET_PATHS = ("/health", "/api/v1/photos/", "/api/v1/reviews/photos/", "/docs", "/openapi.json", "/redoc")
LEADING_KEYS = {"ts": "timestamp", "level": "string", "logger": "string", "event": "string", "message": "string", "request_id": "string", "actor": "string"}
# ----------------------------------------------------------------------------------------------------


def parse_events(lines: DataFrame, column: str = "value", extra: dict[str, str] | None = None) -> DataFrame:
    """JSON lines → the leading keys as typed columns, wanted extra keys, and the whole line as a variant."""
    doc = F.try_parse_json(F.col(column))
    rest = [c for c in lines.columns if c != column]
    keys = {**LEADING_KEYS, **(extra or {})}
    return (
        lines.withColumn("_doc", doc)
        .select(*rest, *[F.try_variant_get("_doc", f"$.{name}", kind).alias(name) for name, kind in keys.items()], F.col("_doc").alias("fields"))
    )


def severity(status: Column, millis: Column, method: Column, path: Column) -> Column:
    quiet = method.isin(*QUIET_METHODS)
    for prefix in QUIET_PATHS:
        quiet |= F.startswith(path, F.lit(prefix))
    return (
        F.when(status >= 500, "error")
        .when((status >= 400) | (millis >= SLOW_MS), "warning")
        .when(quiet, "debug")
        .otherwise("info")
    )


def request_trace(events: DataFrame, request: str, ts: str, columns: list[str], outcome: str) -> DataFrame:
    """Every event of a request with its place in time, plus the request's start and final outcome.

    The trace stays in long form: requests are as long as they are, nothing is gathered into one cell.
    """
    order = F.struct(ts, *columns)
    ends = events.groupBy(request).agg(
        F.min(ts).alias("started"), F.max(ts).alias("finished"), F.count(F.lit(1)).alias("events"), F.max_by(outcome, order).alias("outcome")
    )
    traced = events.select(request, ts, *columns).join(ends, request)
    return traced.withColumn("offset_ms", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000)


def stage_shares(df: DataFrame, stages: list[str], total: str, keys: list[str]) -> DataFrame:
    """Long form: share of each stage in the total time, at most 100 %."""
    pairs = ", ".join(f"'{s}', cast(`{s}` AS double)" for s in stages)
    long = df.select(*keys, total, F.expr(f"stack({len(stages)}, {pairs}) AS (stage, millis)"))
    share = F.when(F.col(total) > 0, F.least(F.lit(100.0), F.col("millis") / F.col(total) * 100)).otherwise(0.0)
    return long.withColumn("share", share)


def stage_percentiles(long: DataFrame) -> DataFrame:
    return exact_quantiles(long, ["stage"], "millis", {"p50": 0.50, "p95": 0.95})


def only_event(events: DataFrame, name: str) -> DataFrame:
    return events.filter(F.col("event") == name)
