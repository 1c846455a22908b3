"""String similarity: Indel ratio, Ratcliff–Obershelp, and exact candidate pairs for a threshold."""

from __future__ import annotations

import difflib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, built-in higher-order functions only."""
    left, right = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.concat(F.array(F.lit("")), right), lambda _: F.lit(0))

    def extend(row: Column, ch: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            best = F.when(
                F.get(right, j - 1) == ch, F.get(row, j - 1) + 1
            ).otherwise(F.greatest(F.get(row, j), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

    table = F.aggregate(left, zero, extend)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(table, -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """2·LCS / (len a + len b): for short strings on few rows; `indel_ratio_udf` serves bulk pairs."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs_length(a, b) / total)


WORD_BITS = 64


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS length of each pair, by bit vectors: bit i of a pair's vector says whether the i-th row of the LCS table steps up.

    All pairs advance by one letter of their longer string at a time; a letter's mask marks where it stands in the shorter one. Shorter strings of
    more than 64 letters take the same steps with Python's long integers.
    """
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    fits = np.array([len(x) <= WORD_BITS for x in short], dtype=bool)
    out = np.zeros(len(short), dtype=np.int64)
    if fits.any():
        at = np.flatnonzero(fits)
        out[at] = _lcs_words([short[i] for i in at], [long[i] for i in at])
    for i in np.flatnonzero(~fits):
        out[i] = _lcs_long(short[i], long[i])
    return out


def _lcs_long(short: str, long: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(short)) - 1
    row = full
    for ch in long:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(short) - row.bit_count()


def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in turn, and the length of each."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32), np.array([len(x) for x in strings], dtype=np.int64)


def _lcs_words(short: list[str], long: list[str]) -> np.ndarray:
    patterns, pattern = np.unique(np.array(short, dtype=object), return_inverse=True)
    texts, text = np.unique(np.array(long, dtype=object), return_inverse=True)
    codes, lengths = _letters(list(patterns))
    alphabet = np.unique(codes)
    masks = np.zeros((len(patterns), len(alphabet) + 1), dtype=np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(patterns)), lengths), np.searchsorted(alphabet, codes)), np.left_shift(np.uint64(1), place.astype(np.uint64)))
    codes, sizes = _letters(list(texts))
    column = np.searchsorted(alphabet, codes)
    column = np.where((column < len(alphabet)) & (alphabet[np.minimum(column, len(alphabet) - 1)] == codes), column, len(alphabet)) if len(alphabet) else np.zeros(len(codes), np.int64)
    letters = np.full((len(texts), int(sizes.max(initial=0))), len(alphabet), dtype=np.int64)  # the last column has no marks
    letters[np.repeat(np.arange(len(texts)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column
    row = np.full(len(short), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):  # carries out of the top bit are meant to be lost
        for j in range(letters.shape[1]):
            hit = row & masks[pattern, letters[text, j]]
            row = (row + hit) | (row - hit)
    width = lengths[pattern].astype(np.uint64)
    low = np.where(width == WORD_BITS, np.iinfo(np.uint64).max, np.left_shift(np.uint64(1), np.minimum(width, WORD_BITS - 1)) - np.uint64(1))
    return np.bitwise_count(~row & low).astype(np.int64)


def indel_ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Indel ratio of aligned strings; pairs of similar length go together, so that short ones don't wait for long ones."""
    left, right = a.fillna("").tolist(), b.fillna("").tolist()
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    order = np.argsort(np.maximum(m, n), kind="stable")
    lcs = np.zeros(len(left), dtype=np.int64)
    for start in range(0, len(left), 4096):
        part = order[start : start + 4096]
        lcs[part] = lcs_lengths([left[i] for i in part], [right[i] for i in part])
    return np.where(m + n > 0, 2.0 * lcs / np.maximum(m + n, 1), 1.0)


@F.pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio for Arrow batches."""
    return pd.Series(indel_ratios(a, b))


@F.pandas_udf(DoubleType())
def ratcliff_ratio_udf(known: pd.Series, word: pd.Series) -> pd.Series:
    """Ratcliff–Obershelp ratio with `word` as the second sequence."""
    matcher = difflib.SequenceMatcher()
    out = np.empty(len(word))
    previous = None
    for row, (first, second) in enumerate(zip(known, word)):
        if second != previous:
            matcher.set_seq2(second)
            previous = second
        matcher.set_seq1(first)
        out[row] = matcher.ratio()
    return pd.Series(out)


# Any fixed order keeps the keys exact; rare letters first keeps the buckets small.
LETTER_ORDER = "0123456789щэъфцюшжхчйыьгбязупдклмвртснаеиоqxzjkvwyfbgphmcudlrtnsoiae"


RARITY = {letter: place for place, letter in enumerate(LETTER_ORDER, start=1)}


def blocking_keys(word: str, share: float) -> tuple[list[str], list[str]]:
    """(letter set, keys) of one word, see `with_candidate_keys`."""
    seen: dict[str, int] = {}
    letters = []
    for ch in sorted(word, key=lambda c: (RARITY.get(c, 0), c)):
        seen[ch] = seen.get(ch, 0) + 1
        letters.append(f"{ch}{seen[ch]}")
    if len(letters) <= 1:
        return letters, [word]
    need = math.ceil(len(letters) * share - 1e-9)
    prefix = letters[: len(letters) - need + 2]
    return letters, [f"{a} {b}" for a, b in itertools.combinations(prefix, 2)]


def with_candidate_keys(df: DataFrame, word: str, threshold: float) -> DataFrame:
    """Adds `_set`, `_keys`, `_len`: two words with 2·common/(m+n) ≥ threshold share at least one key.

    Letters are numbered by occurrence (`anna` → n1 n2 a1 a2), rare letters first. If two such sets
    overlap in `need` or more elements, their first `size - need + 2` elements share two, so pairs of
    prefix elements are the keys. The common count bounds both LCS and matching blocks from above, so
    no similar pair is lost. A one-letter word can only equal its partner.
    """
    if threshold <= 2 / 3:
        raise ValueError("candidate keys are exact only above 2/3")
    share = threshold / (2.0 - threshold)

    def batch(words: pd.Series) -> pd.DataFrame:
        pairs = [blocking_keys(w, share) for w in words]
        return pd.DataFrame({"set": [p[0] for p in pairs], "keys": [p[1] for p in pairs]})

    # not deterministic for the optimizer: filters on the keys must not re-run the function below
    keys = F.pandas_udf(batch, "set array<string>, keys array<string>").asNondeterministic()
    return (
        df.withColumn("_k", keys(F.col(word)))
        .select(*df.columns, F.col("_k.set").alias("_set"), F.col("_k.keys").alias("_keys"), F.length(word).alias("_len"))
    )


def similar_pairs(
    words: DataFrame,
    known: DataFrame,
    threshold: float,
    word: str = "word",
    other: str = "known",
    scorer=indel_ratio_udf,
    condition: Column | None = None,
) -> DataFrame:
    """All pairs of `words` × `known` whose ratio reaches `threshold`, with column `ratio`.

    Both inputs must hold distinct strings (plus columns used by `condition`). Equal blocking keys
    find the candidates, bounds on length and shared letters thin them, Arrow scores the rest.
    """
    left = with_candidate_keys(words, word, threshold).select("*", F.explode("_keys").alias("_key"))
    right = with_candidate_keys(known, other, threshold)
    right = right.select(*[F.col(c) for c in known.columns], F.col("_set").alias("_oset"), F.col("_keys").alias("_okeys"),
                         F.col("_len").alias("_olen"), F.explode("_keys").alias("_key"))
    total = F.col("_len") + F.col("_olen")
    pairs = left.join(right, "_key").filter(2.0 * F.least("_len", "_olen") / total >= threshold)
    if condition is not None:
        pairs = pairs.filter(condition)
    return (
        pairs.filter(F.col("_key") == F.array_min(F.array_intersect("_keys", "_okeys")))
        .filter(2.0 * F.size(F.array_intersect("_set", "_oset")) / total >= threshold - 1e-9)
        .select(*words.columns, *known.columns)
        .withColumn("ratio", scorer(F.col(other), F.col(word)))
        .filter(F.col("ratio") >= threshold)
    )
