"""Exact substring deduplication by Rabin-Karp hashes of every fixed-length word window.

1. `packed`: documents are written once to the shared folder as compressed chunks of a few MB, so that later passes see the same rows together.
2. Each chunk hashes all its windows. A window that occurs several times in the chunk is sent once, with its first
   place; its later places are known to be repeats there and then, so a passage of a third of all documents reaches the
   shuffle once per chunk. Hashes are dealt out by range, sorted, and sent as packed numbers; a part holds a fixed amount of text's windows.
3. Per part, the first chunk of each hash is the one with the smallest (document, chunk); every other chunk gets one bit per window it sent.
4. The bits go back to the chunks, which mark all words of repeated windows; overlapping windows merge into maximal intervals.

Windows are compared by 64-bit hash: with n windows about n**2 / 2**65 unequal pairs are taken for equal, 0.0005 at 10**8.

Defined results: null text has no words; null ids count as later than all others; of rows with the same id the one in the earlier
chunk or row counts as earlier; an empty table gives an empty result. All columns of the input stay; result
columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import aside, lean, materialize, pack_sorted, raw_texts, slices, starts_inside, unpack_sorted, window_hashes, word_hashes

WINDOW = 20
CHUNK_BYTES = 4 << 20
PART_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max
RESULTS = "n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept string"


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, n_bytes, rows): the documents as Arrow streams of about CHUNK_BYTES of text, written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for piece in slices(batches, text, CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(piece)
            size = pa.compute.sum(pa.compute.binary_length(piece.column(piece.schema.get_field_index(text)))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "n_bytes", "rows"])
            n += 1

    return materialize(docs.mapInArrow(pack, "chunk long, n_bytes long, rows binary"), "chunks")


def opened(rows: bytes, id_col: str, text: str) -> tuple[pa.Table, np.ndarray]:
    """The rows of a chunk in the order of their ids, and the ids as numbers."""
    lean()
    table = pa.ipc.open_stream(rows).read_all()
    ids = pa.compute.fill_null(table.column(id_col).cast(pa.int64()), LAST).to_numpy()
    order = np.argsort(ids, kind="stable")
    return table.take(pa.array(order)).combine_chunks(), ids[order]


class Windows:
    """All windows of a chunk: `starts`, the sorted distinct hashes, and for each window its hash's number and whether it is the first."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        self.size = size
        self.words, hashed, self.bounds = word_hashes(texts)
        self.starts = starts_inside(self.bounds, size)
        windows = window_hashes(hashed, size)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        self.distinct, self.first, self.number = np.unique(windows, return_index=True, return_inverse=True)

    def cuts(self, parts: int) -> np.ndarray:
        """Where the distinct hashes pass from one of `parts` equal ranges to the next."""
        limits = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.distinct, limits), [len(self.distinct)]])

    def marked(self, again: np.ndarray) -> np.ndarray:
        """Which words stand in a repeated window. again: the distinct hashes that an earlier chunk has too."""
        repeated = again[self.number]
        later = np.ones(len(self.number), bool)
        later[self.first] = False
        at = self.starts[repeated | later]
        steps = np.bincount(at, minlength=int(self.bounds[-1]) + 1) - np.bincount(at + self.size, minlength=int(self.bounds[-1]) + 1)[: int(self.bounds[-1]) + 1]
        return np.cumsum(steps)[:-1] > 0


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The input with n_words, n_removed, removed (maximal intervals of word numbers, stop excluded) and kept (the
    remaining words, joined by one space). A word goes if a window over it has its word sequence at an earlier place."""
    schema = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "removed", "kept")]
    docs = docs.select(*[f.name for f in schema])
    chunks = packed(docs, text)
    parts = max(1, -(-(chunks.agg(F.sum("n_bytes")).first()[0] or 0) // PART_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, ids = opened(rows.as_py(), id_col, text)
                found = Windows(raw_texts(table.column(text).combine_chunks()), window)
                found.words = []
                row = (np.searchsorted(found.bounds, found.starts[found.first], side="right") - 1).astype(np.uint32)
                cuts = found.cuts(parts)
                out = []
                for k in range(parts):
                    a, b = cuts[k], cuts[k + 1]
                    if a < b:
                        used, where = np.unique(row[a:b], return_inverse=True)
                        out.append((k, chunk, pack_sorted(found.distinct[a:b]), where.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), pack_sorted(ids[used].view(np.uint64))))
                yield pa.RecordBatch.from_pydict({n: [x[i] for x in out] for i, n in enumerate(sent.names)}, schema=sent)

    sent = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())])

    def judge(table: pa.Table) -> pa.Table:
        lean()
        hashes, docs_of, chunk_of, sizes = [], [], [], []
        for h, d, i, c in zip(*(table.column(n).to_pylist() for n in ("hashes", "docs", "ids", "chunk")), strict=True):
            hashes.append(unpack_sorted(h))
            ids = unpack_sorted(i).view(np.int64)
            docs_of.append(ids[np.frombuffer(d, "<u2" if len(ids) <= 1 << 16 else "<u4")])
            sizes.append(len(hashes[-1]))
            chunk_of.append(np.full(sizes[-1], c, np.int64))
        h, again = np.concatenate(hashes), np.zeros(sum(sizes), bool)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # hashes of several chunks only
        d, c = np.concatenate(docs_of), np.concatenate(chunk_of)
        ranked = shared[np.lexsort((c[shared], d[shared], h[shared]))]
        again[ranked] = np.concatenate([[False], h[ranked][1:] == h[ranked][:-1]])[: len(ranked)]
        bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.chunked_array([pa.array(bits, pa.binary())])})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table, _ = opened(left.column("rows")[0].as_py(), id_col, text)
        found = Windows(raw_texts(table.column(text).combine_chunks()), window)
        cuts, again = found.cuts(parts), np.zeros(len(found.distinct), bool)
        for part, bits in zip(right.column("part").to_pylist(), right.column("bits").to_pylist(), strict=True):
            a, b = cuts[part], cuts[part + 1]
            again[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        gone = found.marked(again)
        n_words, n_removed, removed, kept = [], [], [], []
        for k, own in enumerate(found.words):
            mask = gone[found.bounds[k] : found.bounds[k + 1]]
            n_words.append(len(own))
            n_removed.append(int(mask.sum()))
            if n_removed[-1]:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                removed.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                own = [own[j] for j in np.flatnonzero(~mask)]
            else:
                removed.append([])
            kept.append(b" ".join(own))
        spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        for name, values in (("n_words", pa.array(n_words, pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("removed", spans), ("kept", pa.array(kept, pa.binary()).cast(pa.string()))):
            table = table.append_column(name, values)
        return table

    sends = chunks.select("chunk", "rows").mapInArrow(send, "part long, chunk long, hashes binary, docs binary, ids binary")
    answers = sends.groupBy("part").applyInArrow(judge, "chunk long, part long, bits binary")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"{columns}, {RESULTS}")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their repeated passages; texts that lose nothing stay as they are. Documents left without words go."""
    safe, back = aside(docs, ("n_words", "n_removed", "removed", "kept"))
    out = dedup_windows(safe, id_col, text).withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.select(*back)
