"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order, round after round. A copy's virtual finish time is the number of words its source has sent
when the copy ends, divided by the source's weight. All copies are range-sorted by finish time and cut where their words reach the budget, so a source
gets words in proportion to its weight until its rounds are over, and the others share what it leaves. The targets are that water level: weight
times level, or all rounds if these are less; the level is the largest of (budget - rounds of the sources that end earlier) / weight of the rest.

Whole documents are taken, so a source misses its target by the documents under way at the cut, one of each source at most.

Everything is DataFrame functions. Running totals are taken over ranges of rows, so neither a large source nor a large group of equal rows meets in one
task; two numbers (level, cut) reach the driver. Texts are read once and go no further than the word count unless `keep_text` asks for them.

Defined results: null text has size 0; a document without words is in no mix (repeats and taken 0, the target is still its source's); null is a
source of its own and comes last; rows with equal or null ids are single documents; equal rows are interchangeable, so which of them is taken once
more is open, but how many is not; an empty table gives no rows. Columns of the input stay, result columns replace those of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import materialize, running_totals, words

WEIGHTS = (5, 2, 1)
ROUNDS = 3
SEED = 20240611
RESULTS = ("size", "source_size", "target", "repeats", "taken")
C = F.col


def shuffled(identity: Column, seed: int) -> Column:
    """A number that depends on seed and id only: the first 15 hexadecimal digits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], rounds: int, share: float) -> tuple[DataFrame, int]:
    """(_source, _of_source) → also _rank, _weight, _first (words of the sources before it) and _target; and the budget.

    Weights are positive whole numbers, dealt to the sources in order of code points, null last, again and again.
    """
    ranked = running_totals(sizes.withColumn("_null", C("_source").isNull()), ["_null", "_source"], F.lit(1), "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (C("_rank") % len(weights) + 1).cast("int"))
    ranked = running_totals(ranked.withColumn("_weight", weight).withColumn("_all", C("_of_source") * rounds), ["_rank"], C("_of_source"), "_first")
    ranked = ranked.withColumn("_ratio", C("_all") / C("_weight"))
    ranked = running_totals(running_totals(ranked, ["_ratio", "_rank"], C("_all"), "_ended"), ["_ratio", "_rank"], C("_weight"), "_gone")
    ranked = materialize(ranked, "sources")
    whole = ranked.agg(F.coalesce(F.sum("_of_source"), F.lit(0)).alias("words"), F.sum("_weight").alias("weight")).first()
    budget = int(whole["words"] * share)
    level = ranked.agg(F.max((F.lit(budget) - C("_ended")) / (F.lit(whole["weight"]) - C("_gone"))).alias("level")).first()["level"]
    target = F.least(C("_weight") * F.lit(level or 0.0), C("_all").cast("double"))
    return ranked.select("_source", "_of_source", "_rank", "_weight", "_first", target.alias("_target")), budget


def finish(turn: Column) -> tuple[Column, Column, Column]:
    """What orders the copies: virtual finish time in round `turn` (from 0), then source, then words sent."""
    sent = turn * C("_of_source") + C("_sent")
    return sent / C("_weight"), C("_rank"), sent


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, share: float = 1.0, id_col: str = "doc_id", text: str = "text", source: str = "source",
    seed: int = SEED, keep_text: bool = False,
) -> DataFrame:
    """Each document with size, source_size, target (its source's), repeats (copies in the mix, `rounds` at most) and taken (words).

    The mix holds `share` of all words. Columns named _sent, _rank, _weight and _of_source order the copies for `mixture`.
    """
    kept = [c for c in docs.columns if c not in RESULTS and (keep_text or c != text)]
    row = F.struct(*[C(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    size = F.size(words(F.coalesce(C(text), F.lit("")))).cast("long")
    sized = materialize(
        docs.select(
            row.alias("_row"), C(source).alias("_source"), C(source).isNull().alias("_null"), size.alias("_size"), F.coalesce(shuffled(C(id_col), seed), F.xxhash64(F.lit(seed), text)).alias("_place"),
            F.xxhash64(id_col, text).alias("_tie"), F.monotonically_increasing_id().alias("_salt"),
        ),
        "sized",
    )
    sources, budget = targets(sized.groupBy("_source").agg(F.sum("_size").alias("_of_source")), weights, rounds, share)
    placed = running_totals(sized, ["_null", "_source", "_place", "_tie", "_salt"], C("_size"), "_before").alias("d")
    joined = placed.join(sources.alias("s"), C("d._source").eqNullSafe(C("s._source")))
    queued = materialize(joined.select("_row", "_size", "_of_source", "_rank", "_weight", "_target", (C("_before") - C("_first") + C("_size")).alias("_sent")), "queued")
    copies = queued.filter("_size > 0").withColumn("_turn", F.explode(F.array(*[F.lit(k).cast("long") for k in range(rounds)])))
    at, rank, sent = finish(C("_turn"))
    ordered = running_totals(copies.select(at.alias("_at"), rank.alias("_rank"), sent.alias("_sent"), "_size"), ["_at", "_rank", "_sent"], C("_size"), "_total")
    cut = ordered.filter(C("_total") + C("_size") <= budget).agg(F.max(F.struct("_at", "_rank", "_sent")).alias("c")).first()["c"]

    def taken(turn: int) -> Column:
        at, rank, sent = finish(F.lit(turn).cast("long"))
        last_at, last_rank, last_sent = (F.lit(x) for x in cut)
        return ((at < last_at) | (at == last_at) & ((rank < last_rank) | (rank == last_rank) & (sent <= last_sent))).cast("int")

    repeats = reduce(lambda a, b: a + b, [taken(k) for k in range(rounds)]) if cut is not None else F.lit(0)
    repeats = F.when(C("_size") > 0, repeats).otherwise(0)
    return queued.select(
        *[C("_row")[c].alias(c) for c in kept], C("_size").alias("size"), C("_of_source").alias("source_size"), C("_target").alias("target"), repeats.alias("repeats"),
        (repeats * C("_size")).alias("taken"), *[c for c in ("_sent", "_rank", "_weight", "_of_source") if c not in kept],
    )


def mixture(mixed: DataFrame) -> DataFrame:
    """The mix itself, range-sorted: a row per copy of `mix`'s rows with copy (from 0), finish and position (words of the mix before it)."""
    at, rank, sent = finish(C("_turn"))
    copies = mixed.filter("repeats > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), C("repeats").cast("long") - 1)))
    copies = copies.withColumns({"copy": C("_turn"), "finish": at, "_all_sent": sent})
    placed = running_totals(copies, ["finish", "_rank", "_all_sent"], C("size"), "position")
    return placed.drop("_turn", "_all_sent", "_sent", "_rank", "_weight", "_of_source").sort("position")
