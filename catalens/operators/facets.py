"""Faceted, rule-scored catalogue search. Searches are rows of a table, so the plan does not grow with their number.

Texts go through an inverted index: a token matches inside a word, so the suffixes of all catalogue words are keyed by their first letters, tokens meet
them by key and prefix, and the words' postings lead to the entries. Filters become a bit mask per (entry, search) of the dimensions that an entry
fails. No bit makes a hit; a single bit makes the entry count for the options of that dimension alone; pairs with more bits play no part
and are dropped inside the join.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.functions.similarity import ratcliff_ratio_udf, similar_pairs
from catalens.functions.text import normalize_query, to_search_latin
from catalens.functions.values import parse_alcohol_avg, stable_shuffle
from catalens.operators.aggregates import one, top_k
from catalens.session import materialize, spread
from catalens.operators.rulebook import WINE_RULES, Dishes, Likes, Rule, RuleBook

# --- fixed values ----------------------------------------------------------------------------------
EXACT_NAME, NAME_PREFIX, ALL_IN_NAME, ELSEWHERE = 100.0, 60.0, 40.0, 20.0
CORRECTION_CUTOFF = 0.75
# ----------------------------------------------------------------------------------------------------

SINGLE = {"types": "type", "colors": "color", "sugars": "sugar", "regions": "region"}
BITS = {dim: 1 << place for place, dim in enumerate(("dishes", "tastes", "types", "colors", "sugars", "regions", "grapes", "rating", "occasions"))}
#: Letters of a suffix by which tokens find it: its first one, two or three.
KEY_LETTERS = 3


@dataclass(frozen=True)
class Search:
    """One search request."""

    query_id: int
    text: str = ""
    occasion: str | None = None
    dishes: tuple[str, ...] = ()
    tastes: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    colors: tuple[str, ...] = ()
    sugars: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    grapes: tuple[str, ...] = ()
    min_rating: float | None = None
    sort: str = "relevance"
    limit: int = 12
    offset: int = 0


SEARCH_SCHEMA = (
    "query_id int, text string, occasion string, dishes array<string>, tastes array<string>, types array<string>, colors array<string>, sugars array<string>, regions array<string>, "
    "grapes array<string>, min_rating double, sort string, limit int, offset int"
)


def search_table(spark: SparkSession, searches: list[Search]) -> DataFrame:
    """Searches as rows, for callers that have them as objects. Any table of this shape will do."""
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(q).values()) for q in searches], SEARCH_SCHEMA)


def prepare_entries(cards: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """Cards (item_id, name, producer, grapes, region, color, sugar, alcohol, description, foods, rating) → search entries."""
    groups = F.create_map(*[F.lit(x) for key, (_, foods) in rules.dishes.items() for food in foods for x in (food, key)])
    description = F.replace(F.lower(F.coalesce("description", F.lit(""))), F.lit("ё"), F.lit("е"))
    entries = spread(cards).withColumn("description", description).withColumn("alcohol", parse_alcohol_avg(F.col("alcohol").cast("string")))
    sparkling = F.coalesce(F.col("sugar").isin(*rules.sparkling_sugars), F.lit(False)) | F.concat_ws(" ", F.lower("name"), "description").rlike(rules.sparkling_pattern)
    hay = F.concat_ws(" ", "name", "producer", F.array_join("grapes", " "), "region", "color", "sugar", F.when(F.col("sparkling"), rules.sparkling_word))
    tastes = []
    for taste in rules.tastes:
        reason = F.coalesce(*[F.when(F.expr(condition), F.expr(reason)) for condition, reason in taste.evidence])
        tastes.append(F.when(reason.isNotNull(), F.struct(F.lit(taste.key).alias("key"), reason.alias("value"))))
    return (
        entries.withColumn("sparkling", sparkling)
        .withColumn("haystack", normalize_query(hay))
        .withColumn("haystack_latin", to_search_latin(F.col("haystack")))
        .withColumn("name_norm", normalize_query(F.col("name")))
        .withColumn("name_latin", to_search_latin(F.col("name_norm")))
        .withColumn("dishes", F.array_distinct(F.transform("foods", lambda f: F.coalesce(F.element_at(groups, f), f))))
        .withColumn("tastes", F.map_from_entries(F.array_compact(F.array(*tastes))))
        .withColumn("type", F.when(F.col("sparkling"), "sparkling").otherwise("still"))
        .withColumn("sugar", F.when(F.col("sugar") != "", F.col("sugar")))
        .withColumn("rating", F.coalesce(F.col("rating"), F.lit(0.0)))
        .withColumn("shuffle", stable_shuffle(F.col("item_id").cast("string")))
    )


def text_tier(text: str) -> Column:
    """100 exact name, 60 name prefix, 40 all tokens in the name, 20 elsewhere, 0 no match. Tokens match as substrings."""
    norm = normalize_query(F.lit(text))
    toks = F.split(norm, " ")
    has = lambda hay, latin: F.forall(toks, lambda t: F.contains(F.col(hay), t) | F.contains(F.col(latin), to_search_latin(t)))
    return (
        F.when(~has("haystack", "haystack_latin"), 0.0)
        .when(F.col("name_norm") == norm, EXACT_NAME)
        .when(F.startswith("name_norm", norm), NAME_PREFIX)
        .when(has("name_norm", "name_latin"), ALL_IN_NAME)
        .otherwise(ELSEWHERE)
    )


def _taste_reason(rules: RuleBook, key: str) -> Column:
    label = next(t.label for t in rules.tastes if t.key == key)
    return F.concat(F.lit(f"{label.lower()} — "), F.element_at("tastes", key))


def _dish_reason(rules: RuleBook, groups) -> Column:
    labels = [F.when(F.array_contains("dishes", g), label.lower()) for g, (label, _) in rules.dishes.items() if g in groups]
    return F.concat(F.lit(rules.dish_reason), F.array_join(F.array_compact(F.array(*labels)), ", "))


def _terms(rules: RuleBook, occasion: str) -> list[tuple[Column, float, Column]]:
    terms = []
    for rule in rules.occasions[occasion][1]:
        if isinstance(rule, Dishes):
            hit = F.arrays_overlap("dishes", F.array(*[F.lit(g) for g in rule.groups]))
            terms.append((hit, rule.points, _dish_reason(rules, rule.groups)))
        elif isinstance(rule, Likes):
            terms.append((F.map_contains_key("tastes", rule.taste), rule.points, _taste_reason(rules, rule.taste)))
        elif isinstance(rule, Rule):
            terms.append((F.coalesce(F.expr(rule.condition), F.lit(False)), rule.points, F.expr(rule.reason)))
    return terms


def occasion_points(rules: RuleBook, occasion: str) -> Column:
    points = F.lit(0.0)
    for condition, value, _ in _terms(rules, occasion):
        points = points + F.when(condition, float(value)).otherwise(0.0)
    return points


def occasion_reasons(rules: RuleBook, occasion: str) -> Column:
    return F.array_compact(F.array(*[F.when(condition, reason) for condition, _, reason in _terms(rules, occasion)]))


def with_occasions(entries: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """Adds `occasions`: occasion → (points, reasons), computed once per entry for all searches."""
    known = [x for key in rules.occasions for x in (F.lit(key), F.struct(occasion_points(rules, key).alias("points"), occasion_reasons(rules, key).alias("reasons")))]
    return entries.withColumn("occasions", F.create_map(*known))


def ready(searches: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """What the searches need once each: `norm`, its distinct `tokens`, `known` (the occasion exists) and the reason for chosen dishes."""
    labels = F.create_map(*[F.lit(x) for key, (label, _) in rules.dishes.items() for x in (key, label)])
    named = F.lower(F.array_join(F.transform("dishes", lambda g: F.coalesce(F.element_at(labels, g), g)), ", "))
    return searches.withColumns({
        "norm": normalize_query(F.col("text")), "tokens": F.array_remove(F.array_distinct(F.split(normalize_query(F.col("text")), " ")), ""),
        "known": F.coalesce(F.col("occasion").isin(*rules.occasions), F.lit(False)), "dish_reason": F.when(F.size("dishes") > 0, F.concat(F.lit(rules.dish_reason), named)),
    })


def _heads(form: Column, lengths: list[int]) -> Column:
    return F.array_compact(F.array(*[F.when(F.length(form) >= n, F.substring(form, 1, n)) for n in lengths]))


def token_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, known): the vocabulary words that hold a token, as it is written or in Latin letters."""
    forms = lambda c: F.explode(F.array(F.struct(F.lit(False).alias("latin"), F.col(c).alias("form")), F.struct(F.lit(True).alias("latin"), to_search_latin(F.col(c)).alias("form"))))
    words = vocabulary.select("known", forms("known").alias("f")).select("known", "f.*")
    suffixes = words.select("known", "latin", F.explode(F.transform(F.sequence(F.lit(1), F.length("form")), lambda i: F.substring("form", i, F.length("form")))).alias("suffix"))
    keyed = suffixes.select("known", "latin", "suffix", F.explode(_heads(F.col("suffix"), list(range(1, KEY_LETTERS + 1)))).alias("head"))
    asked = tokens.select("token", forms("token").alias("f")).select("token", "f.*").filter("form <> ''")
    asked = asked.withColumn("head", F.substring("form", 1, KEY_LETTERS))
    return asked.join(keyed.hint("merge"), ["latin", "head"]).filter(F.startswith("suffix", F.col("form"))).select("token", "known").distinct()


def text_matches(entries: DataFrame, searches: DataFrame) -> DataFrame:
    """(query_id, item_id, in_name) for entries that hold all tokens of a search; in_name: all of them in the name."""
    asked = searches.select("query_id", F.explode("tokens").alias("token"))
    in_name = F.array_contains(F.split("name_norm", " "), F.col("known"))
    postings = entries.select("item_id", "name_norm", F.explode(F.array_distinct(F.split("haystack", " "))).alias("known")).filter("known <> ''").select("item_id", "known", in_name.alias("in_name"))
    words = token_words(asked.select("token").distinct(), postings.select("known").distinct())
    found = words.join(postings.hint("merge"), "known").groupBy("token", "item_id").agg(F.max("in_name").alias("in_name"))
    sizes = searches.select("query_id", F.size("tokens").alias("n"))
    per = asked.join(found, "token").groupBy("query_id", "item_id").agg(one("hit"), F.min("in_name").alias("in_name"))
    return per.join(sizes, "query_id").filter(F.col("hit") == F.col("n")).select("query_id", "item_id", "in_name")


def failed_mask(rules: RuleBook) -> Column:
    """The bits of the dimensions in which an entry fails a search."""
    fails = {"dishes": F.size(F.array_except("q.dishes", "e.dishes")) > 0, "tastes": F.size(F.array_except("q.tastes", F.map_keys("e.tastes"))) > 0}
    for dim, column in SINGLE.items():
        fails[dim] = (F.size(f"q.{dim}") > 0) & ~F.coalesce(F.array_contains(f"q.{dim}", F.col(f"e.{column}")), F.lit(False))
    fails["grapes"] = (F.size("q.grapes") > 0) & ~F.arrays_overlap("q.grapes", "e.grapes")
    fails["rating"] = F.coalesce(F.col("e.rating") < F.col("q.min_rating"), F.lit(False))
    fails["occasions"] = F.col("q.known") & (F.element_at("e.occasions", F.col("q.occasion"))["points"] < rules.min_occasion)
    mask = F.lit(0)
    for dim, fail in fails.items():
        mask = mask + F.when(F.coalesce(fail, F.lit(False)), BITS[dim]).otherwise(0)
    return mask


#: What searches look at in an entry besides its number; copies that agree in it are met once.
LOOKED_AT = ("name", "name_norm", "rating", "type", "color", "sugar", "region", "grapes", "dishes", "tastes", "occasions")


def examine(entries: DataFrame, searches: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """One row per (entry, search) that matters: the text matches and at most one dimension fails (`mask`). Entries come from `with_occasions`.

    Searches without a text have to be held against every entry; pairs that fail twice end inside that join.
    """
    q = ready(searches, rules)
    return _examined(entries, q, _texts(entries, q), rules, ["shuffle"])


def _texts(entries: DataFrame, q: DataFrame) -> DataFrame:
    """(norm, item_id, in_name): what each distinct text of the searches finds."""
    asked = q.filter(F.size("tokens") > 0).groupBy("norm").agg(F.any_value("tokens").alias("tokens"))
    return text_matches(entries, asked.withColumnRenamed("norm", "query_id")).withColumnRenamed("query_id", "norm")


def _examined(entries: DataFrame, q: DataFrame, texts: DataFrame, rules: RuleBook, extra: list[str], only: Column | None = None) -> DataFrame:
    """Pairs of entries (item_id, LOOKED_AT) and searches. The columns `extra` come from `texts` where it has them, else from the entries.

    Sizes guessed from files are far too small for entries, so no join here may send them to all machines.
    """
    mask = failed_mask(rules)
    tier = F.when(F.col("e.name_norm") == F.col("q.norm"), EXACT_NAME).when(F.startswith("e.name_norm", F.col("q.norm")), NAME_PREFIX).when(F.col("m.in_name"), ALL_IN_NAME).otherwise(ELSEWHERE)
    known = F.element_at("e.occasions", F.col("q.occasion"))
    labels = F.create_map(*[F.lit(x) for t in rules.tastes for x in (t.key, f"{t.label.lower()} — ")])
    liked = F.transform(F.array_intersect("q.tastes", F.map_keys("e.tastes")), lambda t: F.concat(F.element_at(labels, t), F.element_at("e.tastes", t)))
    no_text = F.array().cast("array<string>")
    dish = F.when(F.col("q.dish_reason").isNotNull(), F.array("q.dish_reason")).otherwise(no_text)
    points = F.when(F.col("q.known"), known["points"]).otherwise(0.0)
    reasons = F.array_distinct(F.concat(F.when(F.col("q.known"), known["reasons"]).otherwise(no_text), dish, liked))
    shown = [F.col(f"e.{c}") for c in ("item_id", *LOOKED_AT) if c != "name_norm"]
    columns = lambda text, side: ["q.query_id", *shown, *[F.col(f"{side}.{c}") for c in extra], text.alias("text"), points.alias("points"), mask.alias("mask"), reasons.alias("reasons")]
    alone = F.bit_count(mask) <= 1 if only is None else mask == only
    met = texts.alias("m").join(entries.alias("e").hint("merge"), F.col("m.item_id") == F.col("e.item_id"))
    with_text = met.join(q.filter(F.size("tokens") > 0).alias("q").hint("merge"), F.col("m.norm") == F.col("q.norm")).filter(alone).select(*columns(tier, "m" if set(extra) <= set(texts.columns) else "e"))
    every = q.filter(F.size("tokens") == 0).coalesce(1).alias("q")
    without = entries.alias("e").hint("shuffle_replicate_nl").join(every, alone).select(*columns(F.lit(0.0), "e"))
    return with_text.unionByName(without)


def _kinds(entries: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kinds, texts, members): entries that agree in LOOKED_AT as one, with their number `n` and the `first` of them in the order of ties,
    those that a text finds alike, and (norm, item_id, shuffle, kind) of all members; norm is NULL for all entries."""
    entries = materialize(entries.select("item_id", "shuffle", "haystack", *LOOKED_AT), "entries")  # rules and normalisation run once
    entries = entries.withColumn("kind", F.md5(F.to_json(F.struct(*LOOKED_AT))))
    members = entries.select("item_id", "shuffle", "kind")
    count = [one("n"), F.min(F.struct("shuffle", "item_id")).alias("first")]
    kinds = entries.groupBy("kind").agg(F.any_value(F.struct(*LOOKED_AT)).alias("_e"), *count).select(F.col("kind").alias("item_id"), "_e.*", "n", "first")
    kinds = kinds.repartition(2 * entries.sparkSession.sparkContext.defaultParallelism)
    found = materialize(_texts(entries, q).join(members.hint("merge"), "item_id"), "found")
    texts = found.groupBy("norm", "kind").agg(F.any_value("in_name").alias("in_name"), *count).withColumnRenamed("kind", "item_id")
    return kinds, texts, members.select(F.lit(None).cast("string").alias("norm"), "*").unionByName(found.drop("in_name"))


def matches(seen: DataFrame) -> DataFrame:
    return seen.filter("mask = 0").withColumn("score", F.col("text") + F.col("points"))


def vocabulary(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode(F.split("haystack", " ")).alias("known")).filter("known <> ''").distinct()


def correct_texts(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, text) → corrected text, NULL where some word has no close catalogue word.

    A word stays if any catalogue word starts with it; else the closest one (Ratcliff–Obershelp ≥ .75,
    ties to the larger word) replaces it. Joins are on prefixes and blocking keys.
    """
    words = texts.select("query_id", F.posexplode(F.split(normalize_query(F.col("text")), " ")).alias("pos", "word"))
    vocab = vocabulary(entries)
    starts = vocab.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("known")), lambda n: F.substring("known", F.lit(1), n))).alias("word")).distinct()
    distinct = words.select("word").distinct()
    kept = distinct.join(starts, "word", "left_semi").withColumn("fixed", F.col("word"))
    odd = distinct.join(starts, "word", "left_anti")
    near = similar_pairs(odd, vocab, CORRECTION_CUTOFF, scorer=ratcliff_ratio_udf)
    near = near.groupBy("word").agg(F.max_by("known", F.struct("ratio", "known")).alias("fixed"))
    fixes = kept.unionByName(near)
    done = words.join(fixes, "word", "left").groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fixed"))), lambda x: x["fixed"]), " ").alias("corrected"),
        F.count_if(F.col("fixed").isNull()).alias("_open"),
    )
    return done.select("query_id", F.when(F.col("_open") == 0, F.col("corrected")).alias("corrected"))


def resolve_texts(entries: DataFrame, searches: DataFrame, rules: RuleBook = WINE_RULES) -> tuple[DataFrame, DataFrame]:
    """(searches with `corrected`, what they see): a text that finds nothing is corrected, if the correction finds something."""
    first = materialize(examine(entries, searches, rules), "seen")
    asked = searches.withColumn("norm", normalize_query(F.col("text"))).filter("norm <> ''")
    empty = asked.join(matches(first).select("query_id").distinct(), "query_id", "left_anti")
    fixed = correct_texts(entries, empty.select("query_id", "text")).filter("corrected IS NOT NULL")
    retry = materialize(empty.join(fixed, "query_id").filter("corrected <> norm").drop("norm").withColumn("text", F.col("corrected")), "retried-searches")
    again = materialize(examine(entries, retry.drop("corrected"), rules), "seen-again")
    better = matches(again).select("query_id").distinct()
    seen = first.join(better, "query_id", "left_anti").unionByName(again.join(better, "query_id", "left_semi").select(*first.columns))
    changes = retry.join(better, "query_id", "left_semi").select("query_id", "corrected")
    return searches.join(changes, "query_id", "left").withColumn("text", F.coalesce("corrected", "text")), seen


def _page_order(by_tie: list[Column]) -> list[Column]:
    by_name, by_score = F.col("sort") == "name", F.col("sort") == "relevance"
    return [F.when(by_name, F.col("name")), F.when(by_score, -F.col("score")), F.when(~by_name, -F.col("rating")), F.when(by_score, -F.size("reasons")), *by_tie]


def _page_span(searches: DataFrame) -> tuple[DataFrame, int]:
    """Which ranks each search shows, and the deepest of all: it bounds what each search sends to the window."""
    span = searches.select("query_id", "sort", F.col("offset").alias("_low"), (F.col("offset") + F.col("limit")).alias("_high"))
    return span, span.agg(F.max("_high").alias("m")).first()["m"] or 0


PAGE_COLUMNS = ("query_id", "rank", "item_id", "name", "score", "reasons", "total")


def result_pages(seen: DataFrame, searches: DataFrame) -> DataFrame:
    """Each search's page of hits in its own order, with its total."""
    span, deepest = _page_span(searches)
    hits = matches(seen).join(span, "query_id")
    totals = hits.groupBy("query_id").agg(one("total"))
    page = top_k(hits, ["query_id"], _page_order([F.col("shuffle"), F.col("item_id")]), deepest).filter((F.col("rank") > F.col("_low")) & (F.col("rank") <= F.col("_high")))
    return page.join(totals, "query_id").withColumn("score", F.round("score", 2)).select(*PAGE_COLUMNS)


def search_pages(entries: DataFrame, searches: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """The pages of `result_pages` straight from the entries. Entries that no search tells apart are examined as one.

    The entries of a page lie in as many kinds at most, those with the best first entries; only these kinds are opened, as deep as a page reaches.
    """
    q = ready(searches, rules)
    kinds, texts, members = _kinds(entries, q)
    span, deepest = _page_span(searches)
    hits = matches(_examined(kinds, q, texts, rules, ["n", "first"], F.lit(0))).join(span.hint("merge"), "query_id")
    totals = hits.groupBy("query_id").agg(F.sum("n").alias("total"))
    asked = q.select("query_id", F.when(F.size("tokens") > 0, F.col("norm")).alias("norm"))
    best = top_k(hits, ["query_id"], _page_order([F.col("first")]), deepest).drop("rank").join(asked, "query_id")
    opened = top_k(members, ["norm", "kind"], [F.col("shuffle"), F.col("item_id")], deepest, "_place")
    best = best.withColumnRenamed("item_id", "kind").withColumnRenamed("norm", "_norm")
    rows = best.join(opened.withColumnRenamed("kind", "_kind").hint("merge"), (F.col("kind") == F.col("_kind")) & F.col("_norm").eqNullSafe(F.col("norm")))
    page = top_k(rows, ["query_id"], _page_order([F.col("shuffle"), F.col("item_id")]), deepest).filter((F.col("rank") > F.col("_low")) & (F.col("rank") <= F.col("_high")))
    return page.join(totals, "query_id").withColumn("score", F.round("score", 2)).select(*PAGE_COLUMNS)


def examine_alike(entries: DataFrame, searches: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """`examine` for counting: entries that agree in what filters and options look at are one row, which `n` of them stand behind."""
    q = ready(searches, rules)
    fits = F.transform_values("occasions", lambda _, v: F.struct(F.when(v["points"] >= rules.min_occasion, float(rules.min_occasion)).otherwise(rules.min_occasion - 1.0).alias("points"), F.array().cast("array<string>").alias("reasons")))
    plain = entries.withColumns({"name": F.lit(""), "name_norm": F.lit(""), "tastes": F.transform_values("tastes", lambda k, v: F.lit("")), "occasions": fits})
    kinds, texts, _ = _kinds(plain, q)
    return _examined(kinds, q, texts, rules, ["n"])


def facet_counts(entries: DataFrame, seen: DataFrame, searches: DataFrame, rules: RuleBook = WINE_RULES) -> DataFrame:
    """Option counts of every dimension for all searches in one aggregate over what they see.

    A single-choice dimension counts entries failing nothing but itself; dishes and tastes count the
    current result; occasions count entries passing all filters, whatever the chosen occasion.
    """
    pair = lambda dim, value: F.struct(F.lit(dim).alias("dim"), value.alias("value"))
    none = F.array().cast("array<struct<dim:string,value:string>>")
    clean = F.col("mask") == 0
    but = lambda dim: clean | (F.col("mask") == BITS[dim])
    lists = [F.when(but(dim) & F.col(column).isNotNull(), F.array(pair(dim, F.col(column)))).otherwise(none) for dim, column in SINGLE.items()]
    lists.append(F.when(but("grapes"), F.transform("grapes", lambda v: pair("grapes", v))).otherwise(none))
    lists.append(F.when(clean, F.transform("dishes", lambda v: pair("dishes", v))).otherwise(none))
    lists.append(F.when(clean, F.transform(F.map_keys("tastes"), lambda v: pair("tastes", v))).otherwise(none))
    fitting = F.filter(F.map_keys("occasions"), lambda k: F.element_at("occasions", k)["points"] >= rules.min_occasion)
    lists.append(F.when(but("occasions"), F.transform(fitting, lambda v: pair("occasions", v))).otherwise(none))
    weight = F.col("n") if "n" in seen.columns else F.lit(1).cast("long")  # rows of `examine_alike` stand for many entries
    counts = seen.select("query_id", weight.alias("_n"), F.explode(F.concat(*lists)).alias("x")).groupBy("query_id", "x.dim", "x.value").agg(F.sum("_n").alias("n"))

    labels = {"occasions": {k: v[0] for k, v in rules.occasions.items()}, "dishes": {k: v[0] for k, v in rules.dishes.items()},
              "tastes": {t.key: t.label for t in rules.tastes}, "types": rules.types}
    fixed = [(dim, value, label, pos) for dim, options in labels.items() for pos, (value, label) in enumerate(options.items())]
    static = entries.sparkSession.createDataFrame(fixed, "dim string, value string, label string, pos long")
    columns = F.array(pair("colors", F.col("color")), pair("sugars", F.col("sugar")), pair("regions", F.col("region")))
    values = entries.select(F.explode(F.concat(columns, F.transform("grapes", lambda v: pair("grapes", v)))).alias("x")).select("x.*")
    freq = values.filter(F.col("value").isNotNull()).groupBy("dim", "value").agg(one("freq"))
    sugar_place = F.create_map(*[x for i, s in enumerate(rules.sugar_order) for x in (F.lit(s), F.lit(i))])
    place = F.when(F.col("dim") == "regions", -F.col("freq")).when(F.col("dim") == "sugars", F.coalesce(F.element_at(sugar_place, F.col("value")), F.lit(len(rules.sugar_order)))).otherwise(0)
    options = freq.select("dim", "value", F.col("value").alias("label"), place.cast("long").alias("pos")).unionByName(static)
    # options without a match are shown too, with 0
    full = options.crossJoin(searches.select("query_id")).join(counts, ["query_id", "dim", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    alpha = F.replace(F.lower("label"), F.lit("ё"), F.lit("е"))
    w = Window.partitionBy("query_id", "dim").orderBy(  # one row per option
        F.when(F.col("dim") == "grapes", -F.col("n")).when(F.col("dim").isin("regions", "sugars", "types"), F.col("pos")).otherwise(0), alpha, "label"
    )
    return full.select("query_id", "dim", F.row_number().over(w).cast("long").alias("place"), "value", "label", "n")
