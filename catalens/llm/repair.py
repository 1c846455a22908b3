"""Conversation structure repair by a persistent audit.

Every row of a conversation is kept (K), given another role (R) or deleted (D), and rows with an empty text may be inserted (I), so that the initials
of the roles read (s?(ua)+)?. The cheapest sequence of edits is found row by row over the four states of that pattern; between equally cheap ones the audit
that comes first in ASCII order wins. Audits that are alive in a state share their prefixes as linked nodes. A node knows its depth, the hash of its
prefix and its ancestors at distances of powers of two, so the first letter in which two audits differ is found by climbing both at
once where hashes differ; where hashes agree but the nodes are not the same, the letters are compared. As an audit's letters fix its costs, no audit is a
proper prefix of an equally cheap one, and comparing before the rest is known is safe.

Conversations of usual length are read by conversation, one at a time. Longer ones are cut into chunks of rows in their order (copies counted, running
totals over ranges): a chunk's best audits from each state to each state form a small table, tables are joined sixteen at a time, the best audit is
cut up again and each chunk repairs its own rows. A digest and an audit are single values, so each streams through one task at the end, in pieces.

Defined results: rows are in order of turn (nulls first), role, text (code points); null roles and texts count as one space; rows with a null id form a
conversation of their own; rows flagged as dropped take no part, a conversation without others has zeros, an empty audit and the digest of
the empty string; an empty table gives no rows. Other columns of the input take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm.common import lean, materialize, running_totals

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\v\f\r"
ENDS = ".!?"
CHUNK_ROWS = 2000
CHUNK_BYTES = 16 << 20
FAN_IN = 16
MODULUS, RADIX = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)
C = F.col

COUNTS = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), "long")
RESULT = COUNTS | {"cost": "long", "audit": "string", "repaired_sha256": "string"}
ARROW = {"long": pa.int64(), "string": pa.string()}
EMPTY = hashlib.sha256(b"").hexdigest()


def follow(state: int, initial: str) -> int | None:
    """The state after a row whose role begins with this letter."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def missing(state: int) -> int:
    """The state after the row that has to follow, the user's or the assistant's."""
    return ASSISTANT if state == USER else USER


class Audit:
    """A string of edits that ends in this node and shares its beginning with others."""

    __slots__ = ("ancestors", "depth", "digest", "letter")

    def __init__(self, parent: Audit | None = None, letter: str = "") -> None:
        self.letter, self.ancestors = letter, []
        self.depth = parent.depth + 1 if parent else 0
        self.digest = (parent.digest * RADIX + ord(letter)) % MODULUS if parent else 0
        step = parent
        while step is not None:  # at distances 1, 2, 4, ...
            self.ancestors.append(step)
            level = len(self.ancestors) - 1
            step = step.ancestors[level] if level < len(step.ancestors) else None

    def at(self, depth: int) -> Audit:
        node, back = self, self.depth - depth
        while back:
            level = back.bit_length() - 1
            node, back = node.ancestors[level], back - (1 << level)
        return node

    def text(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.ancestors[0]
        return "".join(reversed(letters))


def equal(a: Audit, b: Audit) -> bool:
    """Whether two audits of the same depth have the same letters, whatever their hashes say."""
    while a is not b and a.depth:
        if a.letter != b.letter:
            return False
        a, b = a.ancestors[0], b.ancestors[0]
    return True


def common(a: Audit, b: Audit) -> int:
    """Length of the longest common prefix."""
    depth = min(a.depth, b.depth)
    a, b = a.at(depth), b.at(depth)
    first, second = a, b
    if a.digest != b.digest:
        for level in range(len(a.ancestors) - 1, -1, -1):
            if level < len(a.ancestors) and a.ancestors[level].digest != b.ancestors[level].digest:
                a, b = a.ancestors[level], b.ancestors[level]
        a, b = a.ancestors[0], b.ancestors[0]
    if equal(a, b):
        return a.depth
    letters = zip(first.text(), second.text(), strict=True)  # unequal prefixes with equal hashes
    return next(i for i, (x, y) in enumerate(letters) if x != y)


def before(a: Audit, b: Audit) -> bool:
    """Whether a's string is less than b's."""
    depth = common(a, b)
    if depth == min(a.depth, b.depth):
        return a.depth < b.depth
    return a.at(depth + 1).letter < b.at(depth + 1).letter


class Row:
    """What the repair must know of a row."""

    __slots__ = ("copies", "fault", "initial")

    def __init__(self, initial: str, fault: str | None, copies: int = 1) -> None:
        self.initial, self.fault, self.copies = initial, fault, copies


Best = dict[int, tuple[int, Audit]]


def offer(best: Best, state: int | None, cost: int, parent: Audit, letter: str) -> None:
    if state is None:
        return
    held = best.get(state)
    if held is None or cost < held[0]:
        best[state] = (cost, Audit(parent, letter))
    elif cost == held[0]:
        other = Audit(parent, letter)
        if before(other, held[1]):
            best[state] = (cost, other)


def inserted(best: Best) -> Best:
    """The states that rows put in here lead to; two of them are enough to come to any state from any other."""
    out = dict(best)
    for state in (START, SYSTEM, ASSISTANT):
        if state in best:
            offer(out, USER, best[state][0] + INSERT, best[state][1], "I")
    if USER in out:
        offer(out, ASSISTANT, out[USER][0] + INSERT, out[USER][1], "I")
    return out


def best_audits(rows: Iterable[Row], start: int = START) -> Best:
    """The cheapest, then least audit from a state to each state."""
    best: Best = inserted({start: (0, Audit())})
    for row in rows:
        faults = [row.fault] + ["duplicate" if row.fault != "blank" else "blank"] * (row.copies - 1)
        for fault in faults:
            after: Best = {}
            for state, (cost, audit) in best.items():
                offer(after, state, cost + DELETE, audit, "D")
                if fault not in ("blank", "duplicate"):
                    extra = TRUNCATED if fault == "truncated" else 0
                    offer(after, follow(state, row.initial), cost + extra, audit, "K")
                    offer(after, missing(state), cost + extra + REROLE, audit, "R")
            best = inserted(after)
    return best


def choose(best: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(best[s] for s in FINAL if s in best)


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """The lines role:text that an audit makes of (role, text) rows."""
    source = iter(rows)
    for letter in audit:
        if letter == "I":
            state = missing(state)
            yield f"{ROLES[state]}:"
            continue
        role, text = next(source)
        if letter == "D":
            continue
        if letter == "R":
            state = missing(state)
            role = ROLES[state]
        else:
            state = follow(state, role[:1])
        yield f"{role}:{text}"


def fault_of(role: str, text: str, seen: set) -> str | None:
    """The first fault of a row; `seen` has the rows before it."""
    bare, again = text.strip(SPACE), (role, text) in seen
    seen.add((role, text))
    return "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ENDS else None


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def mend(rows: list[tuple[int | None, str, str]]) -> dict:
    """All results for one conversation: (turn, role, text) rows in their order."""
    seen: set = set()
    faults = [fault_of(role, text, seen) for _, role, text in rows]
    best = best_audits(Row(role[:1], fault) for (_, role, _), fault in zip(rows, faults, strict=True))
    cost, audit = choose({s: (c, a.text()) for s, (c, a) in best.items()})
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    lines = "\n".join(repaired(((role, text) for _, role, text in rows), audit))
    return {
        "gaps": gaps([t for t, _, _ in rows]), **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost,
        "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest(),
    }


def by_key(df: DataFrame, keys: list[str], order: list[str], rest: list[str], of_key: Callable[[tuple, Iterator[tuple]], Iterable[dict]], columns: dict[str, str]) -> DataFrame:
    """of_key over the rows (columns order + rest) of each key, which stream in order; its dicts (conv and `columns`) become rows."""
    frame = df.select(*keys, *order, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    shape = T.StructType([T.StructField("conv", df.schema["conv"].dataType)])
    for name, kind in columns.items():
        shape = shape.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = kinds or [batch.schema.field(0).type]
                for at in range(0, batch.num_rows, 500):
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, 500).columns], strict=True)

        def packed(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, pa.schema([("conv", kinds[0]), *[(n, ARROW[k]) for n, k in columns.items()]]))

        held: list[dict] = []
        for key, members in groupby(rows(), key=lambda r: r[: len(keys)]):
            for row in of_key(key, (r[len(keys) :] for r in members)):
                held.append(row)
                if len(held) == 500:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return frame.mapInArrow(run, shape)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None,
    chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations of more than chunk_rows rows or chunk_bytes bytes go in chunks of chunk_rows rows.
    """
    plain = rows.select(
        C(conv).alias("conv"), C(turn).cast("long").alias("turn"), F.coalesce(C(role), F.lit(" ")).alias("role"), F.coalesce(C(text), F.lit(" ")).alias("text"),
        (F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))).alias("gone"),
    )
    held = plain.groupBy("conv").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large = materialize(held.filter((C("rows") > chunk_rows) | (C("bytes") > chunk_bytes)).select("conv"), "long-conversations")

    def one(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
        yield {"conv": key[0], **mend([r[:3] for r in members if not r[3]])}

    if large.isEmpty():
        return by_key(plain, ["conv"], ["turn", "role", "text"], ["gone"], one, RESULT).withColumnRenamed("conv", conv)
    inside = plain["conv"].eqNullSafe(large["conv"])
    usual = by_key(plain.join(large, inside, "left_anti"), ["conv"], ["turn", "role", "text"], ["gone"], one, RESULT)
    return usual.unionByName(repair_long(plain.join(large, inside, "left_semi").filter("not gone"), large, chunk_rows)).withColumnRenamed("conv", conv)


PLACE = ["turn", "role", "text", "part"]


def numbered(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The rows with their fault and the chunk they belong to. Rows that are equal in all are one row with their number, in parts of a chunk at most."""
    digest = F.sha2(C("text").cast("binary"), 256)
    counted = rows.withColumn("digest", digest).groupBy("conv", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("all"))
    counted = materialize(counted, "counted-rows")
    order = F.struct(C("turn").isNotNull(), C("turn"))
    repeats = counted.groupBy("conv", "role", "digest").agg(F.sum("all").alias("n"), F.min(order).alias("first")).filter("n > 1").alias("r")
    joined = counted.alias("c").join(repeats, C("c.conv").eqNullSafe(C("r.conv")) & (C("c.role") == C("r.role")) & (C("c.digest") == C("r.digest")), "left")
    bare = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    fault = F.when(bare == "", "blank").when(C("first") < order, "duplicate").when(~F.substring(bare, -1, 1).isin(*ENDS), "truncated")
    faulty = joined.select("c.conv", "turn", "c.role", "text", "all", fault.alias("fault"))
    parts = faulty.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((C("all") - 1) / chunk_rows).cast("long"))))
    copies = F.least(F.lit(chunk_rows).cast("long"), C("all") - C("part") * chunk_rows)
    later = F.when((C("part") > 0) & (F.coalesce("fault", F.lit("")) != "blank"), "duplicate").otherwise(C("fault"))
    placed = running_totals(parts.withColumns({"copies": copies, "fault": later}), ["conv", *PLACE], C("copies"), "place").alias("p")
    of_conv = placed.groupBy("conv").agg(F.min("place").alias("from"), F.countDistinct("turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high")).alias("f")
    chunk = F.floor((C("place") - C("from")) / chunk_rows).cast("long")
    return placed.join(of_conv, C("p.conv").eqNullSafe(C("f.conv"))).select("p.conv", chunk.alias("chunk"), *PLACE, "copies", "fault", "turns", "low", "high")


def of_chunk(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
    """The counts of a chunk and its best audits from each state to each state."""
    listed, counts, illegal, gap = [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
    for _, role, _, _, copies, fault, turns, low, high in members:
        gap = high - low + 1 - turns if turns else 0
        initial = role[:1]
        if fault:
            counts[fault] += 1
        counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        illegal += (copies - 1) * (initial * 2 not in LEGAL) + (bool(listed) and listed[-1].initial + initial not in LEGAL)
        listed.append(Row(initial, fault, copies))
    best = {s: {t: (c, a.text()) for t, (c, a) in best_audits(listed, s).items()} for s in STATES}
    yield {"conv": key[0], "chunk": key[1], "first": listed[0].initial, "last": listed[-1].initial, "gaps": gap, **counts, "illegal": illegal, "best": json.dumps(best)}


def read_best(packed: str) -> dict[int, dict[int, tuple[int, str]]]:
    return {int(s): {int(t): tuple(x) for t, x in to.items()} for s, to in json.loads(packed).items()}


def joined_chunks(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
    """Neighbouring chunks as one: an audit from state to state is the best of those over a state between."""
    whole: dict = {}
    for _, first, last, gap, blank, duplicate, truncated, illegal, packed in members:
        step = read_best(packed)
        if not whole:
            whole = {"first": first, "last": last, "gaps": gap, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "best": step}
            continue
        whole["illegal"] += illegal + (whole["last"] + first not in LEGAL)
        whole |= {"last": last, "blank": whole["blank"] + blank, "duplicate": whole["duplicate"] + duplicate, "truncated": whole["truncated"] + truncated}
        for s, to in whole["best"].items():
            ways = {t: [(c + step[m][t][0], a + step[m][t][1]) for m, (c, a) in to.items() if t in step[m]] for t in STATES}
            whole["best"][s] = {t: min(w) for t, w in ways.items() if w}
    yield {"conv": key[0], "chunk": key[1], **whole, "best": json.dumps(whole["best"])}


def decided(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
    for *counts, packed in members:
        cost, audit = choose(read_best(packed)[START])
        yield {"conv": key[0], **dict(zip(COUNTS, counts, strict=True)), "cost": cost, "audit": audit}


def audit_parts(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
    """Cuts a conversation's audit, its first row, into those of the chunks after it, with the state each begins in."""
    _, _, audit = next(members)
    sizes = [(chunk, n) for chunk, n, _ in members]
    written = len(audit) - audit.count("D")  # an odd number of rows begins with a system row
    begun = at = 0
    for i, (chunk, n) in enumerate(sizes):
        end = at + n
        while (short := n - (end - at - audit.count("I", at, end))) > 0:
            end += short
        end = len(audit) if i + 1 == len(sizes) else end
        state = START if not begun else SYSTEM if written % 2 and begun == 1 else USER if (begun - written % 2) % 2 else ASSISTANT
        yield {"conv": key[0], "chunk": chunk, "edits": audit[at:end], "state": state}
        begun, at = begun + end - at - audit.count("D", at, end), end


def repaired_lines(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
    """The repaired rows of a chunk; its first row is its part of the audit."""
    _, _, _, _, _, _, edits, state = next(members)
    rows = ((role, text) for _, _, role, text, _, copies, _, _ in members for _ in range(copies))
    for i, line in enumerate(repaired(rows, edits, state)):
        yield {"conv": key[0], "chunk": key[1], "line": i, "content": line}


def digest_of_lines(key: tuple, members: Iterator[tuple]) -> Iterator[dict]:
    digest, between = hashlib.sha256(), b""
    for _, _, content in members:
        digest.update(between + content.encode())
        between = b"\n"
    yield {"conv": key[0], "repaired_sha256": digest.hexdigest()}


def repair_long(rows: DataFrame, convs: DataFrame, chunk_rows: int) -> DataFrame:
    """The same results for conversations that no task should hold whole."""
    light = materialize(numbered(rows, chunk_rows), "numbered-rows")
    table = {"chunk": "long", "first": "string", "last": "string", **COUNTS, "best": "string"}
    rest = [c for c in table if c != "chunk"]
    tables = materialize(by_key(light, ["conv", "chunk"], PLACE, ["copies", "fault", "turns", "low", "high"], of_chunk, table), "chunk-audits")
    while (tables.agg(F.max("chunk").alias("m")).first()["m"] or 0) > 0:
        nearby = tables.withColumn("place", C("chunk")).withColumn("chunk", F.floor(C("chunk") / FAN_IN).cast("long"))
        tables = materialize(by_key(nearby, ["conv", "chunk"], ["place"], rest, joined_chunks, table), "joined-audits")
    final = materialize(by_key(tables, ["conv"], [], [*COUNTS, "best"], decided, COUNTS | {"cost": "long", "audit": "string"}), "long-audits")

    null = F.lit(None)
    sizes = light.groupBy("conv", "chunk").agg(F.sum("copies").alias("n")).withColumn("audit", null.cast("string"))
    sizes = sizes.unionByName(final.select("conv", F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n"), "audit"))
    parts = by_key(sizes, ["conv"], ["chunk"], ["n", "audit"], audit_parts, {"chunk": "long", "edits": "string", "state": "long"})
    head = parts.select("conv", "chunk", F.lit(0).alias("kind"), *[null.cast(light.schema[c].dataType).alias(c) for c in [*PLACE, "copies"]], "edits", "state")
    body = light.select("conv", "chunk", F.lit(1).alias("kind"), *PLACE, "copies", null.cast("string").alias("edits"), null.cast("long").alias("state"))
    lines = by_key(head.unionByName(body), ["conv", "chunk"], ["kind", *PLACE], ["copies", "edits", "state"], repaired_lines, {"chunk": "long", "line": "long", "content": "string"})
    digests = by_key(lines, ["conv"], ["chunk", "line"], ["content"], digest_of_lines, {"repaired_sha256": "string"})

    out = convs.alias("c").join(final.alias("f"), C("c.conv").eqNullSafe(C("f.conv")), "left").join(digests.alias("d"), C("c.conv").eqNullSafe(C("d.conv")), "left")
    zeros = [F.coalesce(C(f"f.{c}"), F.lit(0).cast("long")).alias(c) for c in [*COUNTS, "cost"]]
    return out.select("c.conv", *zeros, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
