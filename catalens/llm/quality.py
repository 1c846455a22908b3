"""Document quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Only DataFrame functions are used. Each document is read once into a few numbers (`features`); every rule
turns them into a vote 1 (good), -1 (bad) or 0 (abstains). `fit` counts vote patterns (at most 3 to the power of the
number of rules, whatever the corpus) and runs expectation-maximisation for a two-class model in which rules vote
independently given the class: each iteration is one Spark aggregate over the stored pattern table, and only the sums per rule reach the
driver. `judge` keeps a document when its posterior probability of being good is at least `threshold`, so a single
bad vote does not reject what the other rules hold for prose.

Defined results: null text counts as no words; a document below the base limits is rejected whatever the
posterior; an empty table gives an empty result and the prior model; repeated rows are judged alike; columns of the
input stay, columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.common import aside, WHITE_SPACE, materialize, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_stop_kinds", "n_shouts", "n_stops")
#: Frequent function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in that is with for was this from not are be have it on as by at or an "
    "de la le et les des que en du un une est pour dans qui sur par au avec pas "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "el los del se las por con no su para una al lo como más y o"
)


def repeated_words(windows: Column, window: int = WINDOW) -> Column:
    """Number of words inside the windows that occur at least twice, from the array of window hashes by start.

    Hashes are only sorted where some hash repeats. A window starting at p covers what the previous repeated one left.
    """

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
    twice = let(ordered, lambda o: F.filter(o, lambda x, k: same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("p"))
    covered = F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def doubled(hashes: str, step: int) -> Column:
    """Hashes of runs twice as long, from the hashes of runs of `step` words by start; the last ones run over the end."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the counts that the rules look at. One pass, no shuffle."""
    safe, back = aside(docs, ("_text", "_words", "_lines", "_runs", "_windows"))
    stay = [k for k, c in enumerate(docs.columns) if c not in (*COUNTS, *EXTRA)]
    kept = [F.col(safe.columns[k]) for k in stay]
    body = F.coalesce(F.col(safe.columns[docs.columns.index(text)]), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = safe.select(*kept, body.alias("_text"), words(body).alias("_words"), lines.alias("_lines"))
    split = split.withColumn("_runs", F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # to the 8 words of a window
        split = split.withColumn("_runs", doubled("_runs", step))
    split = split.withColumn("_windows", F.slice("_runs", 1, F.greatest(F.size("_words") - WINDOW + 1, F.lit(0))))

    def count(of: str) -> Column:
        return F.length("_text") - F.length(F.replace("_text", F.lit(of), F.lit("")))

    stop_words = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS.split())])
    facts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_windows")),
        "n_lines": F.size("_lines"),
        "n_stop_kinds": F.size(F.array_intersect("_words", stop_words)),
        "n_shouts": count("!"),
        "n_stops": count("."),
    }
    return split.select(*[back[k] for k in stay], *[value.cast("long").alias(name) for name, value in facts.items()])


def base_failed() -> Column:
    """Too short, or too much of the text stands in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name of the rule → vote. Junk detectors vote bad or abstain, signs of prose vote good, bad or abstain."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    mean_chars = per_word("word_chars")

    def vote(good: Column | None, bad: Column) -> Column:
        out = F.when(bad, F.lit(-1))
        return (out if good is None else out.when(good, F.lit(1))).otherwise(F.lit(0))

    return {
        "length": vote(F.col("n_words") >= 40, F.col("n_words") < MIN_WORDS),
        "word_length": vote((mean_chars >= 3) & (mean_chars <= 7), (mean_chars < 2) | (mean_chars > 9)),
        "symbols": vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.15),
        "duplicate_lines": vote(None, 4 * F.col("n_dup_lines") > F.col("n_lines")),
        "repetition": vote(None, 100 * F.col("n_repeat_words") > 15 * F.col("n_words")),
        "function_words": vote(F.col("n_stop_kinds") >= 2, F.col("n_stop_kinds") == 0),
        "shouting": vote(None, per_word("n_shouts") > 0.2),
        "sentences": vote((per_word("n_stops") > 0.01) & (per_word("n_stops") < 0.4), F.col("n_stops") == 0),
    }


@dataclass(frozen=True)
class Model:
    """prior: share of good documents. vote[name][v] = (P(v | good), P(v | bad)) for v in 1, 0, -1."""

    prior: float
    vote: dict[str, dict[int, tuple[float, float]]]
    iterations: int = 0

    def accuracy(self, name: str) -> float:
        """Probability that the rule is right when it doesn't abstain."""
        right = self.prior * self.vote[name][1][0] + (1 - self.prior) * self.vote[name][-1][1]
        return right / max(right + self.prior * self.vote[name][-1][0] + (1 - self.prior) * self.vote[name][1][1], 1e-12)

    def posterior(self, votes: dict[str, Column]) -> Column:
        """P(good | votes) as a column."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, column in votes.items():
            weight = {v: math.log(g / b) for v, (g, b) in self.vote[name].items()}
            odds = odds + F.when(column == 1, weight[1]).when(column == -1, weight[-1]).otherwise(weight[0])
        return 1 / (1 + F.exp(-odds))


#: Belief before any data: a rule is mostly right when it votes. PRIOR_SHARE is its weight as a share of the corpus.
BELIEF = {1: (0.5, 0.1), 0: (0.4, 0.4), -1: (0.1, 0.5)}
PRIOR_GOOD, PRIOR_SHARE = 0.8, 0.02


def fit(featured: DataFrame, iterations: int = 12, tolerance: float = 1e-3) -> Model:
    """Accuracies of the rules by EM over the counted vote patterns of all documents above the base limits."""
    votes = rules()
    names = list(votes)
    model = Model(PRIOR_GOOD, {name: dict(BELIEF) for name in names})
    patterns = featured.filter(~base_failed()).select(*[v.alias(f"v_{n}") for n, v in votes.items()]).groupBy(*[f"v_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n"))
    patterns = materialize(patterns.coalesce(1), "vote-patterns")  # at most 3 ** len(rules) rows
    columns = {n: F.col(f"v_{n}") for n in names}
    for step in range(1, iterations + 1):
        weighed = patterns.select(*columns.values(), "n", (F.col("n") * model.posterior(columns)).alias("good"))
        sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
        for name in names:
            for v in (1, 0, -1):
                here = F.col(f"v_{name}") == v
                sums += [F.sum(F.when(here, F.col("good"))).alias(f"{name} {v} good"), F.sum(F.when(here, F.col("n") - F.col("good"))).alias(f"{name} {v} bad")]
        total = weighed.agg(*sums).first()
        if not total["n"]:
            break
        good, bad, extra = total["good"], total["n"] - total["good"], PRIOR_SHARE * total["n"]
        vote = {
            name: {v: (((total[f"{name} {v} good"] or 0.0) + extra * g) / (good + extra), ((total[f"{name} {v} bad"] or 0.0) + extra * b) / (bad + extra)) for v, (g, b) in BELIEF.items()}
            for name in names
        }
        prior = (good + extra * PRIOR_GOOD) / (good + bad + extra)
        moved = max(abs(vote[n][v][k] - model.vote[n][v][k]) for n in names for v in BELIEF for k in (0, 1))
        model = Model(prior, vote, step)
        if moved < tolerance:
            break
    return model


def judge(featured: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds posterior, base_failed and kept."""
    posterior = model.posterior(rules())
    return featured.withColumns({"posterior": posterior, "base_failed": base_failed(), "kept": ~base_failed() & (posterior >= threshold)})


def kept_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents that are kept, with the columns of the input. The counts are stored beside the whole rows, so texts are split once."""
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_body"))
    featured = materialize(features(whole, "_body").drop("_body"), "quality")
    return judge(featured, fit(featured), threshold).filter("kept").select("_row.*")


__all__ = ["COUNTS", "WHITE_SPACE", "Model", "base_failed", "features", "fit", "judge", "kept_documents", "repeated_words", "rules"]
