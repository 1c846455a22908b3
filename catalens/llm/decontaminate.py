"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are word sequences: lower case, punctuation at word ends removed. Seeds are the Karp-Rabin hashes of
all runs of MIN_TILE words of the items; each document looks its own runs up there. For every (document, item) with
enough seeds, matches are extended along their diagonals and the longest match whose words are all unmarked is marked as a
tile, again and again, until none of MIN_TILE words is left. Tiles may lie in any order, so reordered passages count. A document is
contaminated by an item when tiles cover at least `threshold` of the item's words. Where seeds repeat so often that their pairs exceed PAIR_SEEDS,
the longest match is found by bisection over its length with running hashes instead, in memory of the two word sequences.

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_WORDS words (one item at least), each block sent to all
tasks, and the documents pass once per block. Documents are never shuffled.

Defined results: null texts have no words; items without an id are left out; items with fewer than MIN_TILE words match nothing; an empty benchmark leaves all
documents clean; repeated items and repeated documents are judged one by one, ties between equally long matches go to
the earlier place in the document, then in the item; columns of the input stay, result columns replace those of the same name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import aside, materialize, raw_texts, slices, starts_inside, window_hashes

MIN_TILE = 5
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
PIECE_BYTES = 2 << 20
#: Pairs of seeds taken at once: over the documents of a piece (of one document at least, which meets each seed of the block once), and of one document with one item.
CHUNK_SEEDS = 1 << 20
PAIR_SEEDS = 1 << 18
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¡¿"
LEAK = pa.struct([("item", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())])))])
LEAKS = "array<struct<item:long,coverage:double,tiles:array<struct<doc_word:long,item_word:long,length:long>>>>"


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word that isn't punctuation only, its number among all words of its text, bounds of the texts)."""
    split = [t.split() for t in texts]
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for x in split for w in x]
    codes, distinct = pd.factorize(flat)
    bare = [w.decode("utf-8", "replace").lower().strip(EDGES) for w in distinct]
    keep = np.array([bool(w) for w in bare], dtype=bool)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in bare), dtype=np.uint64, count=len(bare))
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(split) + 1, np.int64)
    there = keep[codes]
    text_of = np.repeat(np.arange(len(split)), sizes)
    number = np.arange(len(codes)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text_of[there], minlength=len(split)))])
    return hashed[codes][there], number[there], bounds


def tiles(doc_at: np.ndarray, item_at: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds of `size` words at (doc_at, item_at): (document word, item word, length), longest first."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, q = doc_at[order], item_at[order]
    new = np.concatenate([[True], (np.diff(d - q) != 0) | (np.diff(d) != 1)])
    first = np.flatnonzero(new)
    lengths = np.diff(np.concatenate([first, [len(d)]])) + size - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(lengths, d[first], q[first], strict=True)]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + k not in in_doc and b + k not in in_item for k in range(-n)]
        if all(free):
            out.append((a, b, -n))
            in_doc.update(range(a, a - n))
            in_item.update(range(b, b - n))
            continue
        k = 0
        while k < -n:  # what is left of it, between tiles marked since
            if free[k]:
                stop = k
                while stop < -n and free[stop]:
                    stop += 1
                if stop - k >= size:
                    heapq.heappush(heap, (k - stop, a + k, b + k))
                k = stop
            else:
                k += 1
    return out


def tiles_by_length(doc: np.ndarray, item: np.ndarray, size: int, inside: np.ndarray) -> list[tuple[int, int, int]]:
    """The tiles that tiles() finds, from the words (as hashes) and which words of the document seeds cover. Each length is the longest that any
    free match has, so a window of that length meets a tile of that length at one of its ends, if at all."""
    free = [inside.copy(), np.ones(len(item), dtype=bool)]

    def windows(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for words, unmarked in zip((doc, item), free, strict=True):
            total = np.concatenate([[0], np.cumsum(unmarked)])
            starts = np.flatnonzero(total[n:] - total[:-n] == n)
            found.append((starts, window_hashes(words, n)[starts]))
        return found

    def common(n: int) -> bool:
        (_, x), (_, y) = windows(n)
        return bool(np.isin(x, y).any())

    out = []
    limit = min(len(doc), len(item))
    while limit >= size and common(size):
        n, too_long = size, limit + 1
        while too_long - n > 1:
            middle = (n + too_long) // 2
            n, too_long = (middle, too_long) if common(middle) else (n, middle)
        (a, x), (b, y) = windows(n)
        places: dict[int, list[int]] = {}
        for place, seed in zip(b[::-1].tolist(), y[::-1].tolist(), strict=True):
            places.setdefault(seed, []).append(place)  # the first one is the last of its list
        there = np.isin(x, y)
        for start, seed in zip(a[there].tolist(), x[there].tolist(), strict=True):
            if not (free[0][start] and free[0][start + n - 1]):
                continue
            left = places[seed]
            while left and not (free[1][left[-1]] and free[1][left[-1] + n - 1]):
                left.pop()
            if left:
                out.append((start, left[-1], n))
                free[0][start : start + n] = False
                free[1][left[-1] : left[-1] + n] = False
        limit = n - 1
    return out


@dataclass(frozen=True)
class Block:
    """Words and seeds of some items: sorted hashes of the seeds, with the item (as its number here) and place of each."""

    ids: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]], size: int) -> Block:
        hashed, _, bounds = sequences([(t or "").encode() for _, t in rows])
        starts = starts_inside(bounds, size)
        seeds = window_hashes(hashed, size)[starts] if len(starts) else np.zeros(0, np.uint64)
        item = np.searchsorted(bounds, starts, side="right") - 1
        order = np.argsort(seeds, kind="stable")
        return Block(np.array([i for i, _ in rows], dtype=np.int64), hashed, bounds, seeds[order], item[order], (starts - bounds[item])[order])

    def leaks(self, texts: list[bytes], size: int, threshold: float) -> list[list[dict]]:
        hashed, number, bounds = sequences(texts)
        out: list[list[dict]] = [[] for _ in texts]
        starts = starts_inside(bounds, size)
        if not len(starts) or not len(self.seeds):
            return out
        runs = window_hashes(hashed, size)[starts]
        low = np.searchsorted(self.seeds, runs)
        hit = np.flatnonzero(self.seeds[np.minimum(low, len(self.seeds) - 1)] == runs)
        if not len(hit):
            return out
        runs, starts = runs[hit], starts[hit]
        doc = np.searchsorted(bounds, starts, side="right") - 1
        order = np.lexsort((starts, runs, doc))
        runs, starts, doc = runs[order], starts[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (runs[1:] != runs[:-1])]))  # one of each seed in a document
        repeats = np.diff(np.append(head, len(runs)))
        low = np.searchsorted(self.seeds, runs[head])
        times = np.searchsorted(self.seeds, runs[head], side="right") - low
        new_doc = np.flatnonzero(np.diff(doc[head], prepend=-1))
        part = (np.cumsum(times) - times)[new_doc] // CHUNK_SEEDS
        borders = np.append(new_doc[np.flatnonzero(np.diff(part, prepend=-1))], len(head))
        for x, y in zip(borders[:-1], borders[1:], strict=True):
            some = times[x:y]
            group = np.repeat(np.arange(x, y), some)
            seed = np.repeat(low[x:y] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
            pair = doc[head[group]] * len(self.ids) + self.item[seed]
            order = np.argsort(pair, kind="stable")
            cut = np.flatnonzero(np.diff(pair[order], prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                rows = order[a:b]
                d, i = int(doc[head[group[rows[0]]]]), int(self.item[seed[rows[0]]])
                places, length = self.place[seed[rows]], int(self.bounds[i + 1] - self.bounds[i])
                if len(np.unique(places[:, None] + np.arange(size))) < threshold * length:
                    continue  # all its seeds together cover too little
                found = self.tiled(i, places, hashed[bounds[d] : bounds[d + 1]], starts - bounds[d], head[group[rows]], repeats[group[rows]], size)
                covered = sum(n for _, _, n in found)
                if covered >= threshold * length:
                    words = number[bounds[d] : bounds[d + 1]]
                    out[d].append({"item": int(self.ids[i]), "coverage": covered / length, "tiles": [{"doc_word": int(words[at]), "item_word": to, "length": n} for at, to, n in sorted(found)]})
        return out

    def tiled(self, item: int, places: np.ndarray, doc: np.ndarray, starts: np.ndarray, first: np.ndarray, repeats: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """Tiles of a document and an item. Each place of the item has the seed that stands in the document at starts[first : first + repeats]."""

        def expand(first: np.ndarray, repeats: np.ndarray) -> np.ndarray:
            return starts[np.repeat(first - (np.cumsum(repeats) - repeats), repeats) + np.arange(int(repeats.sum()))]

        if int(repeats.sum()) <= PAIR_SEEDS:
            return tiles(expand(first, repeats), np.repeat(places, repeats), size)
        first, once = np.unique(first, return_index=True)
        edges = np.zeros(len(doc) + 1, dtype=np.int64)
        at = expand(first, repeats[once])
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        return tiles_by_length(doc, self.words[self.bounds[item] : self.bounds[item + 1]], size, np.cumsum(edges[:-1]) > 0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with `leaks`: for each item that contaminates them its id, coverage and tiles (empty if clean)."""
    docs = docs.select(*[c for c in docs.columns if c != "leaks"])
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).filter("id is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * BLOCK_WORDS)))  # about six characters a word
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for k in range(blocks):
        block = docs.sparkSession.sparkContext.broadcast(Block.of([(r["id"], r["t"]) for r in items.filter(F.col("block") == k).select("id", "t").sort("id", "t").collect()], min_tile))

        def mark(batches: Iterator[pa.RecordBatch], block=block, more: bool = k > 0) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, text, PIECE_BYTES):
                found = block.value.leaks(raw_texts(piece.column(piece.schema.get_field_index(text))), min_tile, threshold)
                if more:  # what earlier blocks have found
                    before = piece.column(piece.schema.get_field_index("leaks")).to_pylist()
                    found = [a + b for a, b in zip(before, found, strict=True)]
                    piece = piece.remove_column(piece.schema.get_field_index("leaks")) if hasattr(piece, "remove_column") else pa.Table.from_batches([piece]).drop_columns("leaks").to_batches()[0]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.list_(LEAK))], names=[*piece.schema.names, "leaks"])

        docs = docs.mapInArrow(mark, f"{columns}, leaks {LEAKS}")
        if k + 1 < blocks:
            docs = materialize(docs, "leaks")
    return docs


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents that no benchmark item contaminates, with the columns of the input."""
    safe, back = aside(docs, ("leaks",))
    return find_leaks(safe, benchmark, text).filter(F.size("leaks") == 0).select(*back)
