"""Word splitting, hashing and packing that several corpus operators share."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.session import scratch_path

#: Runs of space, tab, line feed, vertical tab, form feed and carriage return separate words; bytes.split() splits at the same six.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


_scratch = threading.local()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back; the table is remembered for `release`."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    tables().append(path)
    return df.sparkSession.read.parquet(path)


def tables() -> list[str]:
    """Folders of intermediate tables that this thread has written and not yet released."""
    if not hasattr(_scratch, "tables"):
        _scratch.tables = []
    return _scratch.tables


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the intermediate tables from number `since` on, but for the last `keep`. What reads them must have been written."""
    own = tables()
    for path in own[since : len(own) - keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del own[since : len(own) - keep]


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, WHITE_SPACE), "")


def trim() -> None:
    """Hand memory that this Python worker has freed back to the system, where the C library can; workers are kept from task to task."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def lean() -> None:
    """From now on this Python worker's Arrow memory goes back to the system when it is freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces whose texts take at most `limit` bytes (or one row)."""
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, before = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])
    trim()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, 64-bit hash of each word of all texts in turn, where each text's words begin and end).

    Each distinct word is hashed once. lower: A-Z only.
    """
    split = [(t.lower() if lower else t).split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
    return split, np.fromiter((known[w] for x in split for w in x), dtype=np.uint64, count=int(bounds[-1])), bounds


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64) of the `size` numbers from each start on, from prefix sums of h[i] * BASE**i."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, n), dtype=np.uint64)])
    return mix((prefix[size:] - prefix[: n - size + 1]) * powers(BASE_INVERSE, n - size + 1))


def starts_inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Starts, in the numbering of all words, of the windows that end in the text they begin in."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    total = int(counts.sum())
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + first


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as steps of as few bytes as the largest step needs."""
    steps = np.diff(values, prepend=np.zeros(1, np.uint64))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    width = packed[0]
    narrow = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :width] = narrow
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """The input with columns of these names renamed, and the columns that give it back."""
    taken = {c.lower() for c in names}
    clash = {c: f"_own_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(clash), [F.col(clash.get(c, c)).alias(c) for c in docs.columns]


def running_totals(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows in a total order, without one task for all rows.

    Rows are range-partitioned by the order and stored with their range; sums inside each range are shifted by the
    total of the ranges before it (as many rows as there are partitions).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.withColumn("_value", value.cast("long")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum("_value").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset", "_value")
