"""Streaming jobs.

Every job gets its folder from the caller: results in <folder>/out, progress in <folder>/checkpoint. Starting again with the
same folder resumes where the last run stopped. State is kept per key in the state store or as the rows that each batch writes, so a batch
costs what its own rows cost, whatever has accumulated before.

Jobs with event time take the watermark delay from the caller: rows that are older than the newest event by more than the
delay come too late and are left out, so the delay must cover the disorder of the source. State is held that much longer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.operators.aggregates import one

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Process everything that is available and not yet processed in this folder; returns the output folder."""
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(out)
    query.awaitTermination()
    return out


def run_changes(changed: DataFrame, folder: str) -> str:
    """Write the rows that each batch changes to <folder>/out/batch=N; a replayed batch overwrites its own rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return run_available(changed, folder, step, "update")


def current_rows(changes: DataFrame, keys: list[str], initial: DataFrame | None = None) -> DataFrame:
    """Newest version of each key from rows with a batch number, over an initial table; rows marked gone are left out."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    rows = changes if initial is None else changes.unionByName(initial.withColumns({"batch": F.lit(-1), **({"gone": F.lit(False)} if "gone" in rest else {})}))
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
    return newest.filter("not gone").drop("gone") if "gone" in rest else newest


# --- keyed tables -------------------------------------------------------------------------------------
def reduced_changes(changes: DataFrame, keys: list[str], payload: list[str], policy: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """What one batch does to each of its keys: whether it deletes (`cleared`), and the puts after its last delete as one `row` with first and last time.

    `row` is the payload that counts under the policy, null without such a put; `_s_<column>` is the last value of a sticky column.
    """
    order = F.struct("ts", "seq")
    marked = changes.withColumn("_gone", F.max(F.when(F.col("op") == "delete", order)).over(Window.partitionBy(*keys)))
    live = F.when((F.col("op") == "put") & (F.col("_gone").isNull() | (order > F.col("_gone"))), order)
    pick = F.max_by if policy == "upsert" else F.min_by
    return marked.groupBy(*keys).agg(
        F.max(F.col("_gone").isNotNull()).alias("cleared"), pick(F.struct(*payload), live).alias("row"), F.min_by("ts", live).alias("first"), pick("ts", live).alias("last"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), live)).alias(f"_s_{c}") for c in sticky],
    )


def folded_changes(reduced: DataFrame, initial: DataFrame, keys: list[str], payload: list[str], policy: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """The table after all batches: an initial table (keys, payload, created_at, updated_at) and, on top of it, what each batch does to its keys."""
    before = initial.select(
        *keys, F.lit(False).alias("cleared"), F.struct(*payload).alias("row"), F.col("created_at").alias("first"), F.col("updated_at").alias("last"), *[F.col(c).alias(f"_s_{c}") for c in sticky], F.lit(-1).cast("long").alias("batch")
    )
    both = reduced.unionByName(before).withColumn("_from", F.max(F.when(F.col("cleared"), F.col("batch"))).over(Window.partitionBy(*keys)))
    rows = both.filter(F.col("row").isNotNull() & (F.col("_from").isNull() | (F.col("batch") >= F.col("_from"))))
    pick = F.max_by if policy == "upsert" else F.min_by
    given = [F.max_by(f"_s_{c}", F.when(F.col(f"_s_{c}").isNotNull(), F.col("batch"))).alias(f"_s_{c}") for c in sticky]
    table = rows.groupBy(*keys).agg(pick("row", "batch").alias("_r"), F.min_by("first", "batch").alias("created_at"), pick("last", "batch").alias("updated_at"), *given)
    kept = [F.col(f"_s_{c}" if c in sticky and policy == "upsert" else f"_r.{c}").alias(c) for c in payload]
    return table.select(*keys, *kept, "created_at", "updated_at")


def change_log_stream(changes: DataFrame, initial: DataFrame, keys: list[str], payload: list[str], policy: str, folder: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """Apply a change stream (keys, payload, op, ts, seq), in the order of its batches, to a table (keys, payload, created_at, updated_at).

    Policies and `sticky` columns are those of `apply_changes`. A batch writes one row per key it touches and needs to know nothing of earlier ones; reading the
    table puts the batches of a key together.
    """
    spark, kinds = changes.sparkSession, dict(changes.dtypes)
    kinds |= {"ts": "timestamp", "row": f"struct<{','.join(f'{c}:{kinds[c]}' for c in payload)}>"}
    stamped = initial.select(*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in payload], *[F.col(c).cast("timestamp").alias(c) for c in ("created_at", "updated_at")])

    def step(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        reduced_changes(timed, keys, payload, policy, sticky).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    out = run_available(changes, folder, step)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "cleared boolean", f"row {kinds['row']}", "first timestamp", "last timestamp", *[f"_s_{c} {kinds[c]}" for c in sticky], "batch long"])
    return folded_changes(spark.read.schema(schema).parquet(out), stamped, keys, payload, policy, sticky)


def latest_view_stream(history: DataFrame, folder: str) -> DataFrame:
    """Latest view per (user, item): a running aggregate that writes the keys each batch changes."""
    order = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), F.col("search_id").alias("i"))
    newest = history.groupBy("user_id", "item").agg(F.min_by(F.struct("created_at", "search_id"), order).alias("r")).select("user_id", "item", "r.*")
    out = run_changes(newest, folder)
    return current_rows(history.sparkSession.read.schema("user_id long, item long, created_at timestamp, search_id long, batch long").parquet(out), ["user_id", "item"])


def log_metrics_stream(events: DataFrame, window: str, delay: str) -> DataFrame:
    """Requests per window and severity."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "severity").agg(one("requests"), F.avg("millis").alias("mean_ms"))
    return rows.select(F.col("window.start").alias("window_start"), "severity", "requests", "mean_ms")

