"""Chat formatting as prefix trees: conversations with the same first turns share those turns' tokens.

A conversation is a path of turns; the key of a turn hashes all turns up to it, so equal keys mean equal beginnings. Distinct paths are
ranked in the order of their keys, which is a depth-first walk of all trees. The first path through a turn owns it. What a
path owns is the rest of it after the longest beginning shared with an earlier path, so each path writes one run of tokens (a branch): every shared
turn is emitted once, depth-first, by its owner. A branch carries the position of its first token in the conversation, and the intervals
of the tree's token sequence that its tokens may attend to besides the branch itself: for each owner of earlier turns the beginning of that owner's branch.

Ranks and offsets are running totals over range partitions; owners are minima per key. So a first turn that a third of all conversations
share is combined before the shuffle, and joins on it can be split. A conversation itself is one sequence and is put together in one task.

Template: <|im_start|>role, line feed, text, <|im_end|>, line feed. Control strings inside roles and texts are broken by an escape sign after
their first character; the sign itself is doubled, a line feed in a role becomes sign and n. The loss mask covers the texts of assistants.

Defined results: null text or role counts as empty; rows of a conversation go by turn (nulls first), then role and text, repeated rows stay;
null ids form one conversation; an empty table gives empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import materialize, running_totals

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SIGN = "␛"
BREAKS = re.compile(f"{SIGN}|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
SIGNS = re.compile(f"{SIGN}(.?)", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    return BREAKS.sub(lambda m: SIGN * 2 if m[0] == SIGN else m[0] + SIGN, text)


def unescape(text: str) -> str:
    return SIGNS.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", SIGN + "n")


def unescape_role(role: str) -> str:
    return SIGNS.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def encoder(vocabulary: str, pattern: str):
    """A byte-level BPE tokenizer from a file of ranks; its ids fit 16 bits."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, leaf, path, turns): one row per conversation; path is the keys of its turns, leaf the last of them."""
    whole = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(whole)).alias("turns"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for turns in batch.column(1).to_pylist():
                path, last = [], b""
                for t in turns:
                    role, text = t["role"].encode(), t["text"].encode()
                    last = hashlib.blake2b(last + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
                    path.append(last)
                paths.append(path)
            leaves = pa.array([p[-1] for p in paths], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), leaves, pa.array([b"".join(p) for p in paths], pa.binary()), batch.column(1)], names=["conv_id", "leaf", "path", "turns"])

    kind = dict(grouped.dtypes)
    return materialize(grouped.mapInArrow(key, f"conv_id {kind['conv_id']}, leaf binary, path binary, turns {kind['turns']}"), "conversations")


def branches(convs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The formatted trees: one row per distinct path with its branch.

    leaf, tree (key of the first turn), offset (of the branch in the tree's sequence), position (of its first token in the
    conversation), attends (intervals before it in the same sequence), ids (16-bit numbers), mask (one byte per token, 1 under the loss).
    """
    paths = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    ranked = materialize(running_totals(paths, ["path"], F.lit(1), "rank"), "paths")
    keys = F.transform(F.sequence(F.lit(0), F.floor(F.length("path") / 16).cast("int") - 1), lambda k: F.substring("path", k * 16 + 1, F.lit(16)))
    nodes = ranked.select("rank", F.posexplode(keys).alias("depth", "node"))
    owned = nodes.join(nodes.groupBy("node").agg(F.min("rank").alias("owner")), "node")
    # Turns of a path by their owners; an owner gives the beginning of its branch.
    shares = materialize(owned.groupBy("rank", "owner").agg(F.count(F.lit(1)).alias("turns"), F.min("depth").alias("depth")), "shares")
    own = shares.filter("rank = owner").select("rank", F.col("depth").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            out = []
            for first, turns in zip(batch.column(batch.schema.get_field_index("first")).to_pylist(), batch.column(batch.schema.get_field_index("turns")).to_pylist(), strict=True):
                ids, mask, ends = [], [], []
                for t in turns[first:]:
                    head, body, tail = encode(f"{START}{escape_role(t['role'])}\n"), encode(escape(t["text"])), encode(f"{END}\n")
                    ids += head + body + tail
                    mask += [0] * len(head) + [int(t["role"] == LEARNED)] * len(body) + [0] * len(tail)
                    ends.append(len(ids))
                out.append((np.array(ids, "<u2").tobytes(), bytes(mask), ends))
            columns = [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("rank", "leaf", "tree")), *columns], names=["rank", "leaf", "tree", "ids", "mask", "ends"])

    texts = ranked.select("rank", "leaf", F.substring("path", 1, 16).alias("tree"), "turns").join(own, "rank")
    written = texts.mapInArrow(write, "rank long, leaf binary, tree binary, ids binary, mask binary, ends array<long>")
    placed = materialize(running_totals(written, ["rank"], F.length("mask"), "at"), "branches")
    starts = placed.select(F.col("rank").alias("owner"), "at", "ends")
    others = shares.filter("rank <> owner").join(starts, "owner")
    spans = others.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "at", (F.col("at") + F.get("ends", F.col("turns").cast("int") - 1)).alias("stop")))).alias("spans"))
    joined = placed.join(spans, "rank", "left").withColumn("tree_at", F.coalesce(F.get("spans", F.lit(0))["at"], F.col("at")))
    attends = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct((s["at"] - F.col("tree_at")).alias("start"), (s["stop"] - F.col("tree_at")).alias("stop")))
    out = joined.select("leaf", "tree", (F.col("at") - F.col("tree_at")).alias("offset"), attends.alias("attends"), "ids", "mask")
    position = F.aggregate("attends", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return materialize(out.withColumn("position", position), "trees")


def read_back(trees: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per path, from ids, masks and intervals alone: leaf, turns (role, text), learned (the texts under the mask), formatted (the whole string)."""
    asked = trees.select("leaf", "tree", F.explode("attends").alias("span")).select("leaf", "tree", F.col("span.start").alias("offset"), (F.col("span.stop") - F.col("span.start")).alias("n"))
    source = trees.select("tree", "offset", "ids", "mask")
    cut = lambda c, width: F.substring(c, F.lit(1), (F.col("n") * width).cast("int"))
    shared = asked.join(source, ["tree", "offset"]).select("leaf", "offset", cut("ids", 2).alias("ids"), cut("mask", 1).alias("mask"))
    pieces = shared.unionByName(trees.select("leaf", "offset", "ids", "mask"))
    whole = pieces.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "mask"))).alias("pieces"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(vocabulary, pattern).decode_bytes
        for batch in batches:
            out = []
            for pieces in batch.column(1).to_pylist():
                ids = np.concatenate([np.frombuffer(p["ids"], "<u2") for p in pieces])
                mask = np.concatenate([np.frombuffer(p["mask"], np.uint8) for p in pieces])
                formatted = decode(ids.tolist()).decode()
                turns = []
                for part in formatted.split(START)[1:]:
                    role, _, text = part.removesuffix(f"{END}\n").partition("\n")
                    turns.append({"role": unescape_role(role), "text": unescape(text)})
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
                out.append((turns, [unescape(decode(ids[a:b].tolist()).decode()) for a, b in edges], formatted))
            columns = [pa.array([x[0] for x in out], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["leaf", "turns", "learned", "formatted"])

    return whole.mapInArrow(parse, "leaf binary, turns array<struct<role:string,text:string>>, learned array<string>, formatted string")
