"""Near-duplicate documents by a chosen-path set similarity join.

Sets are the distinct word shingles of a text. Documents with equal sets are one class, so exact copies never meet as pairs. The classes go
down independent trees: the root of each picks two minwise hash functions of its own, a deeper node two by its hash, and each member follows the branch of its
own minwise token. Two sets of similarity J share a child with probability 1 - (1 - J)**2. Most nodes are small after one level; `trees_for` takes as many
trees as lose a pair that has to go down all LEVELS with probability LOSS at most (at 0.85: four; a pair of one level is lost once in four million cases).

- A node of at most LEAF members is compared exhaustively in one row: a spanning forest of the best sketch agreements names its candidates.
- A larger node does the same in blocks dealt by a hash of (node, id), so each tree mixes them anew, and branches on.
- The candidates are confirmed on the full sets; the links give first components. Then nodes that hold several components compare all
  members of different components by sketch; what is large after LEVELS levels does so in blocks: everything outside its main component with everything, first for the
  best partners only. Of pairs that agree enough, an upper bound of the shared shingles from 16-bit marks leaves those that can be links; they are confirmed
  on the full sets too. So a hot group of near copies costs a link per copy and not a link per pair, and no link between different components is left out.

Components are minimum labels spread along links with pointer jumping; labels and links stay in tables.

Defined results: null or blank text has an empty set, is linked with nothing and is kept; rows with equal ids count as one document; null ids count as the largest id, and such
rows are kept only if their component has no other id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import lean, materialize, mix, powers, raw_texts, release, slices, starts_inside, tables, trim, window_hashes, word_hashes

WORDS = 5
PERCENT = 80
#: Minwise hash functions; the first CHOICES are open to branches, the lowest bytes of all make the sketch.
HASHES, CHOICES = 128, 64
LEVELS, LEAF, LOSS = 2, 1024, 1e-5
BLOCK = 1024
PIECE_BYTES = 2 << 20
BROADCAST_IDS = 500_000
LAST = np.iinfo(np.int64).max


def least_agreement(percent: int) -> int:
    """Equal sketch bytes that a pair of this similarity falls below once in a million cases (4.75 standard deviations)."""
    p = percent / 100
    return int(HASHES * p - 4.75 * (HASHES * p * (1 - p)) ** 0.5)


def trees_for(percent: int, loss: float = LOSS) -> int:
    """Trees that lose a pair of this similarity, if it goes down all levels, with probability `loss` at most."""
    kept = (1 - (1 - percent / 100) ** 2) ** LEVELS
    return min(CHOICES // 2, max(1, math.ceil(math.log(loss) / math.log(1 - kept)))) if kept < 1 else 1


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, by text and hash. A text of fewer than `size` words is one shingle."""
    _, hashed, bounds = word_hashes(texts, lower=True)
    starts = starts_inside(bounds, size)
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    found = window_hashes(hashed, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    lengths = np.diff(bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    whole = np.array([mix(np.array([(hashed[bounds[t] : bounds[t + 1]] * powers(0x9FB21C651E98DF25, int(lengths[t]))).sum(dtype=np.uint64) + np.uint64(lengths[t])]))[0] for t in short], dtype=np.uint64)
    text_of, found = np.concatenate([text_of, short]), np.concatenate([found, whole])
    order = np.lexsort((found, text_of))
    text_of, found = text_of[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (text_of[1:] != text_of[:-1]) | (found[1:] != found[:-1])
    return text_of[new], found[new]


def signatures(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, a, b, minwise, sketch) per row, stored: a and b digest the set."""
    odd = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, PIECE_BYTES):
            rows = piece.num_rows
            text_of, found = shingles(raw_texts(piece.column(1)), size)
            n = np.bincount(text_of, minlength=rows)
            a, b, least = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros((rows, HASHES), np.uint32)
            full = np.flatnonzero(n)
            if len(full):
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                a[full] = np.add.reduceat(mix(found ^ np.uint64(0x51ED2701)), at)
                b[full] = np.add.reduceat(mix(found + np.uint64(0xA5A5A5A5A5)), at)
                for k in range(HASHES):
                    least[full, k] = np.minimum.reduceat(((found * odd[k]) >> np.uint64(32)).astype(np.uint32), at)
            ids = pa.compute.fill_null(piece.column(0).cast(pa.int64()), LAST)
            choices = np.ascontiguousarray(least[:, :CHOICES]).reshape(-1).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * CHOICES), pa.array(choices))
            sketches = pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists, sketches], names=["doc_id", "n_shingles", "a", "b", "minwise", "sketch"])

    return materialize(docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(sign, "doc_id long, n_shingles long, a long, b long, minwise array<int>, sketch binary"), "signatures")


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(doc_id, shingles, marks) of the documents named in `ids`, stored. marks: the distinct lowest 16 bits of the shingles."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, PIECE_BYTES):
            text_of, found = shingles(raw_texts(piece.column(1)), size)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=piece.num_rows))]).astype(np.int32)
            low = (found & np.uint64(0xFFFF)).astype("<u2")
            marks = pa.array([np.unique(low[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(found.view(np.int64))), marks], names=["doc_id", "shingles", "marks"])

    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text))
    return materialize(only(named, ids, "left_semi").mapInArrow(collect, "doc_id long, shingles array<long>, marks binary"), "sets")


def only(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Semi or anti join with a stored list of ids: sent to all tasks if it has at most BROADCAST_IDS rows, else by a shuffle."""
    ids = ids.select(F.col(ids.columns[0]).alias(id_col))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, how)


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) with labels lowered to the minimum over what links (x, y) connect. labels holds every id of the links."""
    both = materialize(links.select("x", "y").union(links.select("y", "x")).distinct(), "links")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("label").alias("near")).withColumnRenamed("x", "id")
        lower = labels.join(near, "id", "left").select("id", F.least("label", "near").alias("lower"), "label")
        # A label is an id itself, which may have got a lower label by now.
        step = lower.select(F.col("id").alias("to"), F.col("lower").alias("jump"))
        jumped = materialize(lower.join(step, F.col("lower") == F.col("to"), "left").select("id", F.least("lower", "jump").alias("label"), F.col("label").alias("old")), "labels")
        labels = jumped.select("id", "label")
        if jumped.filter("label < old").isEmpty():
            return labels


NODE = "array<struct<id:bigint,n:bigint,sketch:binary,label:bigint,marks:binary>>"


class Members:
    """Members of nodes as columns: id, size of the set, sketch, label (of a component, or null), marks (or null)."""

    def __init__(self, flat: pa.StructArray) -> None:
        self.ids, self.n = flat.field("id").to_numpy(), flat.field("n").to_numpy()
        self.labels = pa.compute.fill_null(flat.field("label"), -1).to_numpy(zero_copy_only=False)
        self.sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.marks = [np.frombuffer(m, "<u2") if m else np.zeros(0, np.uint16) for m in flat.field("marks").to_pylist()]
        self.bits: dict[int, np.ndarray] = {}

    def bitmap(self, k: int) -> np.ndarray:
        """The marks of a member as 65536 bits."""
        if k not in self.bits:
            own = np.zeros(1 << 16, np.uint8)
            own[self.marks[k]] = 1
            self.bits[k] = np.packbits(own).view(np.uint64)
        return self.bits[k]

    def possible(self, x: np.ndarray, other: Members, k: int, percent: int, best: bool = False) -> np.ndarray:
        """Which members x may be similar enough to member k of the other side (best: the most similar of them). Shared shingles are at most the shared marks and what
        shares a mark within the set that has fewer such, so no similar pair is lost."""
        if not len(x):
            return np.zeros(0, bool)
        shared = np.bitwise_count(np.stack([self.bitmap(int(i)) for i in x]) & other.bitmap(k)).sum(axis=1, dtype=np.int64)
        twice = np.minimum(np.array([self.n[i] - len(self.marks[i]) for i in x]), other.n[k] - len(other.marks[k]))
        common = np.minimum(shared + twice, np.minimum(self.n[x], other.n[k]))
        union = self.n[x] + other.n[k] - common
        enough = 100 * common >= percent * union
        return enough & (np.arange(len(x)) == np.argmax(common / union)) if best else enough

    def agreement(self, x: np.ndarray, other: Members, y: np.ndarray, percent: int) -> np.ndarray:
        """Equal sketch bytes of pairs, 0 where the sets' sizes rule the similarity out."""
        out, step = np.zeros(len(x), np.int64), 1 << 16
        fit = np.flatnonzero(100 * np.minimum(self.n[x], other.n[y]) >= percent * np.maximum(self.n[x], other.n[y]))
        for at in range(0, len(fit), step):
            k = fit[at : at + step]
            out[k] = (self.sketch[x[k]] == other.sketch[y[k]]).sum(axis=1)
        return out


def pairs_inside(nodes: pa.ListArray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of all pairs of members of the same node; at most about `limit` pairs at a time, nodes whole."""
    bounds = nodes.offsets.to_numpy() - nodes.offsets[0].as_py()
    sizes = np.diff(bounds)
    for size in np.unique(sizes):  # nodes of one size together
        i, j = np.triu_indices(int(size), 1)
        at = bounds[:-1][sizes == size]
        for part in np.array_split(at, max(1, len(at) * len(i) // limit)):
            yield (part[:, None] + i).ravel(), (part[:, None] + j).ravel()


def spanning(m: Members, at: int, size: int, percent: int, enough: int) -> list[tuple[int, int]]:
    """Places (x, y) of a spanning forest of the strongest agreements among members at..at+size (Prim's method, row by row)."""
    best, partner = np.full(size, -1), np.zeros(size, np.int64)
    left, out, now = np.arange(size), [], 0
    while len(left) > 1:
        left = left[left != now]
        same = m.agreement(np.full(len(left), at + now), m, at + left, percent)
        better = same > best[left]
        best[left[better]], partner[left[better]] = same[better], now
        now = left[np.argmax(best[left])]
        if best[now] >= enough:
            out.append((at + int(partner[now]), at + int(now)))
    return out


def best_links(nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y): of each node (a row of arrays) a spanning forest of its members' best agreements, as far as they agree enough."""
    enough = least_agreement(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            m = Members(batch.column(0).flatten())
            bounds = batch.column(0).offsets.to_numpy() - batch.column(0).offsets[0].as_py()
            sizes = np.diff(bounds)
            pairs = bounds[:-1][sizes == 2]
            pairs = pairs[m.agreement(pairs, m, pairs + 1, percent) >= enough]
            found = [(int(x), int(x) + 1) for x in pairs]
            for at, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                found += spanning(m, int(at), int(size), percent, enough)
            x, y = (m.ids[np.array([f[k] for f in found], dtype=np.int64)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])
        trim()

    return nodes.mapInArrow(compare, "x long, y long")


def pairs_apart(nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of members of small nodes that agree enough and have different labels."""
    enough = least_agreement(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            m = Members(batch.column(0).flatten())
            for x, y in pairs_inside(batch.column(0)):
                other = m.labels[x] != m.labels[y]
                x, y = x[other], y[other]
                near = m.agreement(x, m, y, percent) >= enough
                order = np.argsort(y[near], kind="stable")
                x, y = x[near][order], y[near][order]
                for part in np.split(np.arange(len(y)), np.flatnonzero(np.diff(y)) + 1):
                    if not len(part):
                        continue
                    own = x[part][m.possible(x[part], m, int(y[part[0]]), percent)]
                    a, b = m.ids[own], np.full(len(own), m.ids[y[part[0]]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])
                if len(m.bits) > BLOCK:
                    m.bits.clear()
        trim()

    return nodes.mapInArrow(compare, "x long, y long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough, stored."""
    one = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("s"))
    other = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t"))
    both = pairs.join(one, "x").join(other, "y")
    return materialize(both.filter(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("x", "y"), "linked")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id in its component), kept (it is that document)."""
    signed = signatures(docs, id_col, text, words)
    classes = signed.filter("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("minwise").alias("minwise"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumnRenamed("n_shingles", "n"), "classes")

    best, small, large = candidates(classes, percent)
    best = materialize(best, "candidates")
    ids = materialize(best.select(F.col("x").alias("id")).union(best.select("y")).union(large.select("id")).distinct(), "candidate-ids")
    sets = full_sets(docs, ids, id_col, text, words)
    labels = components(ids.withColumn("label", F.col("id")), linked(best, sets, percent))
    members = classes.select("id", "n", "sketch").join(sets.select(F.col("doc_id").alias("id"), "marks"), "id").dropDuplicates(["id"])
    for first in (False,) if large.isEmpty() else (True, False):  # large nodes join each member's best partner first, so few pairs are left for the pass over all
        known = materialize(members.join(labels, "id"), "members")
        apart = large_apart(large, known, percent, first)
        for nodes in () if first else small:
            several = nodes.join(labels, "id").groupBy("node").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("node")
            apart = apart.union(pairs_apart(gathered(nodes.join(several, "node").join(known, "id")), percent))
        links = linked(apart.distinct(), sets, percent)
        if not links.isEmpty():
            labels = components(labels, links)

    of_class = classes.select("a", "b", F.col("n").alias("n_shingles"), "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).drop("id")
    out = signed.drop("minwise", "sketch").join(of_class, ["a", "b", "n_shingles"], "left").withColumn("component", F.coalesce("label", "doc_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return out.select(known("doc_id").alias("doc_id"), "n_shingles", known("component").alias("component_id"), ((F.col("doc_id") == F.col("component")) | (F.col("n_shingles") == 0)).alias("kept"))


def gathered(members: DataFrame) -> DataFrame:
    """Nodes of at most LEAF members, one row of arrays each."""
    return members.groupBy("node").agg(F.collect_list(F.struct("id", "n", "sketch", "label", "marks")).cast(NODE).alias("m")).select("m")


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(candidate pairs (x, y), small nodes (node, id) of each level, nodes (node, id) that are still large at the last level)."""
    light = classes.select("id", "n", "sketch")
    unknown = {"label": F.lit(None).cast("long"), "marks": F.lit(None).cast("binary")}
    child = lambda node, k: F.xxhash64(node, k, F.get("minwise", k))
    roots = F.array(*[child(F.lit(t), F.lit(k)) for t in range(trees_for(percent)) for k in (2 * t, 2 * t + 1)])
    rows = classes.select("id", F.explode(roots).alias("node"))
    found, small = [], []
    for level in range(LEVELS):
        if level:
            pick = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(CHOICES)).cast("int")
            other = F.pmod(pick + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(CHOICES - 1)).cast("int"), F.lit(CHOICES))
            rows = crowd.join(classes.select("id", "minwise"), "id").select("id", F.explode(F.array(child(F.col("node"), pick), child(F.col("node"), other))).alias("node"))
        sized = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        nodes = materialize(rows.join(sized, "node"), "nodes")
        small.append(nodes.filter(F.col("size") <= LEAF).select("node", "id"))
        block = F.xxhash64("node", F.pmod(F.xxhash64("id", "node"), F.ceil(F.col("size") / LEAF)))  # a small node is one block
        found.append(best_links(gathered(nodes.select(block.alias("node"), "id").join(light.withColumns(unknown), "id")), percent))
        crowd = nodes.filter(F.col("size") > LEAF).select("node", "id")
        if crowd.isEmpty():
            break
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    return best.distinct(), small, crowd


def large_apart(large: DataFrame, known: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (x, y) that agree enough in large nodes, between a member outside the node's main component and any member of another component.

    best: for each such member only its best partner in each block. Both sides are cut into blocks, so a group compares at most about BLOCK * BLOCK pairs.
    """
    named = large.join(known, "id")
    counted = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"))
    main = counted.groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all"), F.max("k").alias("most"))
    main = main.filter("parts > 1").select("node", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("outer"))
    mixed = materialize(named.join(main, "node"), "mixed")
    block = lambda count: F.pmod(F.xxhash64("id"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    keys, member = ["node", "p", "q"], F.struct("id", "n", "sketch", "label", "marks").alias("m")
    inner = mixed.select("node", block("blocks").alias("p"), every("outer").alias("q"), member)
    outside = mixed.filter("label <> main").select("node", every("blocks").alias("p"), block("outer").alias("q"), member)
    enough = least_agreement(percent)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            a, b = (Members(t.column("m").combine_chunks()) for t in (left, right))
            for k in range(len(b.ids)):
                x = np.flatnonzero(a.labels != b.labels[k])
                x = x[a.agreement(x, b, np.full(len(x), k), percent) >= enough]
                x = x[a.possible(x, b, k, percent, best)]
                out.append((np.minimum(a.ids[x], b.ids[k]), np.maximum(a.ids[x], b.ids[k])))
        return pa.table({"x": np.concatenate([x for x, _ in out]), "y": np.concatenate([y for _, y in out])})

    return inner.groupBy(*keys).cogroup(outside.select(*[F.col(c).alias(c) for c in (*keys, "m")]).groupBy(*keys)).applyInArrow(compare, "x long, y long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each group of near duplicates. An id goes if none of its rows is kept."""
    before = len(tables())
    judged = near_duplicates(docs, id_col, text).groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id")).agg(F.max("kept").alias("kept"))
    gone = materialize(judged.filter("not kept").select("doc_id"), "near-duplicates")
    release(docs.sparkSession, before, keep=1)
    keyed = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))
    return only(keyed, gone, "left_anti", "_id").select(*docs.columns)
