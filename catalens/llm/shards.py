"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: the shard by rendezvous hashing of the id (one more shard only takes rows into itself),
the bucket inside the shard by a second seeded hash over id and text. Each shard has as many buckets as it has
BUCKET_BYTES, so a bucket fits a task's memory whatever the corpus. Pass two brings each bucket together, applies the
Fisher-Yates shuffle seeded by (seed, shard, bucket) and writes it; the buckets of a shard follow each other, so slots are
gapless. A lost task repeats with the same result, because a bucket is put in id order before it is shuffled.

Defined results: a null id takes the hash of the text in its place; null text has size 1 and stays null in the files; rows with equal ids share the
shard; rows that are equal in id and text share the bucket while they hold a quarter of one at most, larger groups are counted, numbered and dealt
out in chunks of an eighth of a bucket; an empty table gives no rows. Columns of the input stay, result columns replace those
of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.common import aside, materialize
from catalens.session import scratch_path

BUCKET_BYTES = 24 << 20
SEED = 20240601


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is highest."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)])["s"] if shards > 1 else F.lit(0)


def shard_of(identity: Column, text: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of a record, from its id and the number of shards alone (from its text where the id is null)."""
    return rendezvous(F.when(identity.isNull(), F.xxhash64(F.lit(seed + 1), text)).otherwise(F.xxhash64(F.lit(seed), identity)), shards, seed)


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1."""
    draws = np.random.Generator(np.random.PCG64(list(seed))).integers(0, np.arange(1, n + 1))
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def dealt(keyed: DataFrame, size: Column, bucket_bytes: int) -> DataFrame:
    """The rows with a _tie of their own for each chunk of a large group of repeats. Repeats are counted before they are shuffled; numbers and thus
    chunks depend on the rows alone."""
    of_tie = keyed.groupBy("_tie").agg(F.count(F.lit(1)).alias("_rows"), F.sum(size.cast("long")).alias("_size")).filter(f"_rows > 1 and _size > {bucket_bytes // 4}")
    large = materialize(of_tie.select("_tie", F.greatest(F.lit(1), F.floor(F.lit(bucket_bytes // 8) * F.col("_rows") / F.col("_size"))).alias("_per")), "repeats")
    if large.isEmpty():
        return keyed
    counted = keyed.join(large, "_tie").groupBy(*keyed.columns, "_per").agg(F.count(F.lit(1)).alias("_rows"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / F.col("_per")).cast("long"))))
    salted = chunks.withColumn("_tie", F.xxhash64("_tie", F.to_json(F.struct(*[c for c in keyed.columns if c != "_tie"])), "_chunk")).repartition("_tie")
    rows = salted.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_per"), F.col("_rows") - F.col("_chunk") * F.col("_per")).cast("long"))))
    return keyed.join(large, "_tie", "left_anti").select(*keyed.columns).unionByName(rows.select(*keyed.columns))


def write_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Writes the documents, with shard, bucket and slot, as Parquet partitioned by shard, and returns what was written."""
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "bucket", "slot")])
    names = docs.columns
    docs, back = aside(docs, ("_tie", "_rows", "_size", "_per", "_chunk", "_one", "_shard", "_bucket"))
    id_col, text = docs.columns[names.index(id_col)], docs.columns[names.index(text)]
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    keyed = docs.withColumns({"shard": shard_of(F.col(id_col), F.col(text), shards, seed), "_tie": F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col(text))})
    held = {r["shard"]: r["n"] for r in keyed.groupBy("shard").agg(F.sum(size.cast("long")).alias("n")).collect()}  # one number per shard
    buckets = F.element_at(F.array(*[F.lit(max(1, -(-held.get(s, 0) // bucket_bytes))) for s in range(shards)]), F.col("shard") + 1)
    keyed = dealt(keyed, size, bucket_bytes).withColumn("bucket", F.pmod("_tie", buckets.cast("long")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = keyed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def shuffle(rows: pa.Table, start: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.drop_columns("_tie").append_column("slot", pa.array([], pa.int64()))
        shard, bucket, first = (start.column(c)[0].as_py() for c in ("_shard", "_bucket", "start"))
        ordered = rows.sort_by([(id_col, "ascending"), ("_tie", "ascending")])
        mixed = ordered.take(pa.array(fisher_yates(rows.num_rows, seed, shard, bucket)))
        return mixed.drop_columns("_tie").append_column("slot", pa.array(np.arange(rows.num_rows) + first))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name != "_tie")
    mixed = keyed.groupBy("shard", "bucket").cogroup(starts.groupBy("_shard", "_bucket")).applyInArrow(shuffle, f"{columns}, slot long").select(*back, "shard", "bucket", "slot")
    path = path or scratch_path(spark, "shards")
    mixed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(mixed.schema).parquet(path)
