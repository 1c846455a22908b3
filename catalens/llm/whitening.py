"""Embedding whitening: projection on the leading principal components, each scaled to unit variance.

Entries become whole numbers floor(scale * c); each distinct vector counts once in the fit. Two passes over these distinct vectors give exact sums per
dimension, then the covariance: every task centres its vectors and adds up its own products, and Spark adds the entries of the tasks' matrices. The
d x d matrix is what the driver sees; d is the length of a vector and does not grow with the rows. There it is brought to tridiagonal form by
Householder reflections; Sturm counts bisect for the leading eigenvalues, inverse iteration finds their vectors, and vectors of close eigenvalues are
made orthogonal in each step. A last pass projects all rows with what is broadcast (d numbers a component).

Defined results: vectors that are null or hold null, NaN or infinite entries are dropped; shorter vectors count as filled up with zeros to the
longest (an empty one is all zeros); entries beyond 64 bits stop at the largest; a component without variance (eigenvalue under d times the
precision of the trace) is left out, so one distinct vector gives no rows, as an empty table does; repeated rows each get their rows. Columns of the input
stay, result columns replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import materialize

SCALE = 256
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
SAFE = 2**62
EXACT = T.DecimalType(38, 0)
#: Partial matrices are added up by task; a task takes as many splits as this leaves to each core.
TASKS_PER_CORE = 4


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)) & ~F.isnan(c.cast("double")))


def block(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """The vectors of a batch as rows of 64-bit numbers."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def added(fit: DataFrame, d: int, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum of of_block over all vectors: each task sends one array, whose entries Spark adds."""
    size, exact = math.prod(shape), kind != "double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=object if exact else np.float64)
        for batch in batches:
            if batch.num_rows:
                total = total + of_block(block(batch, "x", d))
        flat = total.reshape(-1)
        values = pa.array([int(v) for v in flat], pa.decimal128(38)) if exact else pa.array(flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), values], names=["at", "value"])

    tasks = TASKS_PER_CORE * fit.sparkSession.sparkContext.defaultParallelism
    parts = fit.coalesce(tasks).mapInArrow(partial, f"at long, value {kind}")
    out = np.zeros(size, dtype=object if exact else np.float64)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():  # size rows, whatever the number of vectors
        out[r["at"]] = int(r["value"]) if exact else r["value"]
    return out.reshape(shape)


def exact_sums(x: np.ndarray) -> np.ndarray:
    large = max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) >= SAFE
    return x.astype(object).sum(axis=0) if large else x.sum(axis=0).astype(object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - sums)**2, exactly."""
    largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    kind = np.int64 if largest**2 * max(1, x.shape[1]) < SAFE else object
    off = x.astype(kind) * n - np.array(sums, dtype=kind)
    return [int(v) for v in (off * off).sum(axis=1)]


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a symmetric matrix: (diagonal, off-diagonal, unit reflectors or zero vectors)."""
    a, reflectors = np.array(matrix, dtype=np.float64), []
    n = len(a)
    for k in range(n - 2):
        column = a[k + 1 :, k]
        v, norm = np.zeros(n), float(np.linalg.norm(column))
        if norm > 0.0 and np.any(column[1:]):
            v[k + 1 :] = column
            v[k + 1] += math.copysign(norm, column[0])
            v /= np.linalg.norm(v)
            p = a @ v
            w = p - (v @ p) * v
            a -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number the count of eigenvalues below it: negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(at), dtype=int), np.ones(len(at))
    with np.errstate(over="ignore"):  # an infinite term has the right sign, and the one after it is as without it
        for i, x in enumerate(diagonal):
            q = x - at - (off[i - 1] ** 2 / q if i else 0.0)
            q = np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues in falling order, bisected until the ends of their intervals touch."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    margin = 1e-14 * float(np.abs(diagonal).max(initial=0) + reach.max(initial=0)) + np.finfo(float).tiny
    low, high = np.full(k, (diagonal - reach).min() - margin), np.full(k, (diagonal + reach).max() + margin)
    order = n - 1 - np.arange(k)  # the eigenvalue with so many below it
    eps = float(np.finfo(float).eps)
    least = eps * eps * float(np.abs(np.concatenate([low, high])).max())
    while np.any(high - low > np.maximum(eps * np.maximum(np.abs(low), np.abs(high)), least)):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_counts(diagonal, off, middle) > order
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return low + (high - low) / 2


def factored(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of (T - shift) x = b by elimination with row exchanges; vanishing pivots count as tiny."""
    n = len(diagonal)
    main, upper, second = [x - shift for x in diagonal.tolist()], [*off.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        below, swap = float(off[i]), abs(off[i]) > abs(main[i])
        if swap:
            main[i], below = below, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
        if abs(main[i]) < tiny:
            main[i] = tiny
        factor = below / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        steps.append((swap, factor))
    if n and abs(main[-1]) < tiny:
        main[-1] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            later = upper[i] * x[i + 1] if i + 1 < n else 0.0
            later += second[i] * x[i + 2] if i + 2 < n else 0.0
            x[i] = (x[i] - later) / main[i]
        return np.array(x)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; within a cluster each is kept orthogonal to those before it."""
    n, eps = len(diagonal), float(np.finfo(float).eps)
    norm = float(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0)) or 1.0
    found, cluster, shift = np.zeros((n, len(values))), [], math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = []
        shift = min(float(value), shift - 4 * eps * norm) if cluster else float(value)  # equal values get shifts of their own
        solve = factored(diagonal, off, shift, eps * norm)
        x = np.random.Generator(np.random.PCG64([7, j])).standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                for i in cluster:
                    x = x - (found[:, i] @ x) * found[:, i]
            x = x / np.linalg.norm(x)
            x = solve(x)
            x = x / np.abs(x).max()
        for _ in range(2):
            for i in cluster:
                x = x - (found[:, i] @ x) * found[:, i]
        found[:, j] = x / np.linalg.norm(x)
        cluster.append(j)
    return found


def principal_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a symmetric matrix and their unit eigenvectors as columns."""
    diagonal, off, reflectors = tridiagonal(covariance)
    values = leading_eigenvalues(diagonal, off, min(k, len(covariance)))
    vectors = eigenvectors(diagonal, off, values)
    for v in reversed(reflectors):
        vectors = vectors - 2.0 * np.outer(v, v @ vectors)
    return values, vectors


def whiten(rows: DataFrame, k: int = 4, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and each of the k leading components (component 1..k), with

    n (distinct vectors), deviation (decimal, sum over dimensions of (n*x - S)**2), whitened, explained (share of the variance) and identity_error
    (largest entry by which the covariance of the whitened distinct vectors differs from the identity).
    """
    kept = [c for c in rows.columns if c not in RESULTS]
    cut = rows.filter(usable(F.col(vector))).select(F.struct(*kept).alias("_row"), whole_numbers(F.col(vector), scale).alias("x"))
    lengths = cut.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    d = lengths["high"] or 0
    if lengths["low"] != lengths["high"]:
        cut = cut.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
    nothing = T.StructType([*rows.select(*kept).schema, *[T.StructField(c, t) for c, t in zip(RESULTS, (T.IntegerType(), T.LongType(), EXACT, *[T.DoubleType()] * 3), strict=True)]])
    if not d:
        return rows.sparkSession.createDataFrame([], nothing)
    fit = materialize(cut.select("x").distinct(), "distinct-vectors")
    n = fit.count()
    sums = added(fit, d, exact_sums, (d,), "decimal(38,0)")
    mean = np.array([v / n for v in sums], dtype=np.float64)

    def products(centre: np.ndarray, project: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def of_block(x: np.ndarray) -> np.ndarray:
            y = project(x) - centre
            return y.T @ y

        return of_block

    covariance = added(fit, d, products(mean, lambda x: x), (d, d), "double") / n
    trace = float(np.trace(covariance))
    values, vectors = principal_components(covariance, k)
    has = values > d * np.finfo(float).eps * trace
    values, vectors = values[has], vectors[:, has]
    if not len(values):
        return rows.sparkSession.createDataFrame([], nothing)
    axes = vectors / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ axes

    found = len(values)
    centre = added(fit, d, lambda x: whitened(x).sum(axis=0), (found,), "double") / n
    error = float(np.abs(added(fit, d, products(centre, whitened), (found, found), "double") / n - np.eye(found)).max())
    explained, exact = [float(v) / trace for v in values], [int(v) for v in sums]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = block(batch, "x", d)
                ends = pa.array(np.arange(0, found * (len(x) + 1), found, dtype=np.int32))
                projected = pa.ListArray.from_arrays(ends, pa.array(whitened(x).reshape(-1)))
                deviation = pa.array(deviations(x, n, exact), pa.decimal128(38))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), deviation, projected], names=["_row", "deviation", "whitened"])

    shape = T.StructType([cut.schema["_row"]]).add("deviation", EXACT).add("whitened", T.ArrayType(T.DoubleType()))
    out = cut.mapInArrow(project, shape)
    each = out.select("_row", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    share = F.element_at(F.array(*[F.lit(v) for v in explained]), F.col("_at") + 1)
    return each.select(
        *[F.col("_row")[c].alias(c) for c in kept], (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
