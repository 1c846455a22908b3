"""Packing token sequences as a cutting-stock problem solved by column generation.

1. Documents are tokenized once and cut into pieces of at most `size` tokens: whole sequences and one remainder each. Pieces, with
   their ids, are written to the shared folder.
2. Remainders are counted by length, rounded up to GRAIN tokens: at most size / GRAIN numbers, whatever the corpus.
3. On those numbers the driver solves the linear program over patterns (how many pieces of each length share a sequence).
   Columns are priced by a knapsack dynamic program over the dual values. Rounding down leaves at most one sequence per length class open, which first-fit decreasing packs.
4. Pieces are ranked within their length class by document; each pattern takes the next ranks of its classes. Ranking is a running total over
   range partitions, and a sequence, with a bounded number of pieces, gets its offsets in one small window.
5. The pieces' ids meet by sequence, are put together, padded and written. What is told about pieces is read back from these sequences.

Padding is what rounding to GRAIN and the open sequences leave. Defined results: null or empty text is the end token alone; rows with equal ids are
packed one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.common import materialize, running_totals, slices

SIZE = 2048
GRAIN = 8
END_ID = 1
#: A piece that fills a sequence alone is the sequence of this number and the piece's.
FULL = 1 << 61
PIECE_BYTES = 1 << 20
SPECIAL = "<|endoftext|>"


def encoder(ranks_file: str, pattern: str, special_id: int = 50256) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE given as ranks. The special token's string counts as that token, as it does by
    default in a tokenizer read from the JSON file of the same vocabulary."""
    import base64

    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    model = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: special_id})
    return lambda text: model.encode_to_numpy(text, allowed_special="all" if SPECIAL in text else set(), disallowed_special=())


def pieces(docs: DataFrame, ranks_file: str, pattern: str, size: int = SIZE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(piece, doc_id, start, length, doc_tokens, ids): stored. ids are 16-bit numbers; END_ID ends each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, n, end = encoder(ranks_file, pattern), TaskContext.get().partitionId(), 0, np.array([END_ID], "<u2").tobytes()
        for part in slices(batches, text, PIECE_BYTES):
            rows = []
            for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                whole = encode(t).astype("<u2").tobytes() + end if t else end
                for at in range(0, len(whole), 2 * size):
                    own = whole[at : at + 2 * size]
                    rows.append(((task << 36) + n, doc, at // 2, len(own) // 2, len(whole) // 2, own))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.binary(),), strict=True)], names=["piece", "doc_id", "start", "length", "doc_tokens", "ids"])

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text))
    return materialize(narrow.mapInArrow(cut, "piece long, doc_id long, start long, length long, doc_tokens long, ids binary"), "pieces")


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total value of any numbers of items within the capacity, and those numbers."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(weights, kind="stable")
    sorted_weights = weights[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = int(np.searchsorted(sorted_weights, c, side="right"))
        if fit:
            totals = values[order[:fit]] + best[c - sorted_weights[:fit]]
            k = int(np.argmax(totals))
            if totals[k] > best[c] + 1e-15:
                best[c], choice[c] = totals[k], order[k]
    counts, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(weights[choice[c]])
    return float(best[capacity]), counts


@dataclass(frozen=True)
class Pattern:
    """times sequences that each hold counts[class] pieces of each length class."""

    counts: dict[int, int]
    times: int


def patterns(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], float]:
    """Patterns that use up the histogram (length class → pieces) exactly, and the lower bound of the linear program.

    Gilmore-Gomory column generation with a revised simplex: the basis starts with one-class patterns; the entering column is the best
    knapsack under the dual values; the solution is rounded down and first-fit decreasing packs the rest.
    """
    weights = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(w)] for w in weights], dtype=np.float64)
    m = len(weights)
    if not m:
        return [], 0.0
    basis = np.diag(capacity // weights).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand
    for step in itertools.count():
        dual = inverse.sum(axis=0)
        value, column = knapsack(dual, weights, capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        grows = direction > 1e-12
        ratios = np.where(grows, amount / np.where(grows, direction, 1), np.inf)
        leaves = int(np.argmin(ratios))
        basis[:, leaves] = column
        pivot = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, pivot)
        inverse[leaves] = pivot
        if step % 100 == 99:  # Newton step against rounding errors
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))
        amount = np.maximum(inverse @ demand, 0)
    left = demand.astype(np.int64)
    out = []
    for k in range(m):
        column = basis[:, k].astype(np.int64)
        used = column > 0
        times = min(int(amount[k] + 1e-6), int((left[used] // column[used]).min()))
        if times > 0:
            out.append(Pattern({int(weights[i]): int(column[i]) for i in np.flatnonzero(used)}, times))
            left -= times * column
    while left.any():  # each pass fills one pattern greedily, as often as the rest allows
        room, counts = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            counts[i] = min(left[i], room // weights[i])
            room -= counts[i] * weights[i]
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        out.append(Pattern({int(weights[i]): int(counts[i]) for i in np.flatnonzero(used)}, times))
        left -= times * counts
    return out, float(amount.sum())


class Plan:
    """Which rank of which class goes to which sequence."""

    def __init__(self, found: list[Pattern]) -> None:
        taken: dict[int, int] = {}
        self.rows: dict[int, list[tuple[int, int, int]]] = {}  # class → (first rank, first sequence, pieces per sequence)
        self.sequences = 0
        for p in found:
            for kind, per in p.counts.items():
                self.rows.setdefault(kind, []).append((taken.get(kind, 0), self.sequences, per))
                taken[kind] = taken.get(kind, 0) + per * p.times
            self.sequences += p.times

    def sequence(self, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kind), np.int64)
        for k in np.unique(kind):
            first, sequence, per = (np.array(x, dtype=np.int64) for x in zip(*self.rows[int(k)], strict=True))
            own = kind == k
            at = np.searchsorted(first, rank[own], side="right") - 1
            out[own] = sequence[at] + (rank[own] - first[at]) // per[at]
        return out


def place(cut: DataFrame, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """The pieces (without ids) with sequence_id and offset. Full pieces are sequences as they are, the rest is packed."""
    kind = F.ceil(F.col("length") / grain).cast("long")
    classed = cut.filter(F.col("length") < size).select("piece", "doc_id", "start", "length", "doc_tokens", kind.alias("kind"))
    histogram = {int(r["kind"]): int(r["n"]) for r in classed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size / grain rows
    found, _ = patterns(histogram, size // grain)
    plan = Plan(found)
    kinds = np.array(sorted(histogram), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum([histogram[int(k)] for k in kinds])]).astype(np.int64)
    ranked = running_totals(classed, ["kind", "doc_id", "start", "piece"], F.lit(1), "rank")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("kind", "rank"))
            sequence = plan.sequence(kind, rank - before[np.searchsorted(kinds, kind)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    columns = ["piece", "doc_id", "start", "length", "doc_tokens", "kind", "rank"]
    assigned = ranked.select(*columns).mapInArrow(assign, ", ".join(f"{c} long" for c in columns) + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.col("kind").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    packed = assigned.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("kind", "rank")
    alone = cut.filter(F.col("length") == size).select("piece", "doc_id", "start", "length", "doc_tokens", (F.col("piece") + FULL).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


PARTS = "array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint>>"


def sequences(placed: DataFrame, cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The packed sequences: sequence_id, ids (16-bit numbers, padded with 0 unless the length is a power of two), n_tokens, and the pieces in order
    (doc_id, start, length, doc_tokens; their ids once more as doc_ids)."""
    short = cut.filter(F.col("length") < size).select("piece", "ids")  # ids of full pieces stay where they are
    parts = placed.filter(F.col("length") < size).select("piece", "sequence_id", "offset", "doc_id", "start", "length", "doc_tokens").join(short, "piece")
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "doc_tokens", "ids"))).alias("p"))  # at most `size` pieces
    joined = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    inside = F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["length"], x["doc_tokens"])).cast(PARTS)
    one = F.array(F.struct("doc_id", "start", "length", "doc_tokens")).cast(PARTS)
    alone = cut.filter(F.col("length") == size).select((F.col("piece") + FULL).alias("sequence_id"), "ids", one.alias("pieces"))
    out = whole.select("sequence_id", joined.alias("ids"), inside.alias("pieces")).unionByName(alone)
    tokens = (F.octet_length("ids") / 2).cast("long")
    power = tokens.bitwiseAND(tokens - 1) == 0
    out = out.withColumns({"n_tokens": tokens, "padded": F.when(power, F.col("ids")).otherwise(F.rpad("ids", 2 * size, F.lit(b"\0")))})
    return out.select("sequence_id", F.col("padded").alias("ids"), "n_tokens", "pieces", F.transform("pieces", lambda x: x["doc_id"]).alias("doc_ids"))


def pack(docs: DataFrame, ranks_file: str, pattern: str, size: int = SIZE) -> DataFrame:
    """The documents as packed sequences, see `sequences`."""
    cut = pieces(docs, ranks_file, pattern, size)
    return sequences(place(cut, size), cut, size)


def contents(packed: DataFrame) -> DataFrame:
    """What the sequences hold, piece by piece: doc_id, start, length, ids_crc32 (of 32-bit little-endian ids), doc_tokens, sequence_id, offset."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sequence, ids, inside in zip(*(batch.column(n).to_pylist() for n in ("sequence_id", "ids", "pieces")), strict=True):
                tokens, at = np.frombuffer(ids, "<u2").astype("<u4"), 0
                for p in inside:
                    own = tokens[at : at + p["length"]]
                    rows.append((p["doc_id"], p["start"], len(own), zlib.crc32(own.tobytes()), p["doc_tokens"], sequence, at))
                    at += len(own)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return packed.select("sequence_id", "ids", "pieces").mapInArrow(read, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
