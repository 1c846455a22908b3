"""Catalogue enrichment: filling gaps, splitting lists, tagging phrases, deriving aliases, glossary extraction."""

from __future__ import annotations

import html
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from catalens.functions.text import blank_to_null, collapse_spaces, match_text, ru_to_lat
from catalens.functions.values import CATALOG_ALCOHOL, TEMPERATURE, format_percent_range, format_temperature, plausible, uuid5
from catalens.operators.aggregates import first_per_key, one
from catalens.operators.dictionary import BLOCK_BYTES, chosen_phrases, phrase_places
from catalens.session import spread

# --- fixed values ----------------------------------------------------------------------------------
KNOWN_SUGARS = ("экстра брют", "брют", "полусухое", "полусладкое", "сухое", "сладкое")
MANUAL_WORDS = {
    "шато": "chateau", "домен": "domaine", "мезон": "maison", "кюве": "cuvee", "резерв": "reserve", "гран": "grand", "крю": "cru", "блан": "blanc",
    "нуар": "noir", "руж": "rouge", "розе": "rose", "брют": "brut", "вайнери": "winery", "эстейт": "estate", "винъярдс": "vineyards", "фэмили": "family",
}
# ----------------------------------------------------------------------------------------------------


def fill_from(df: DataFrame, other: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Take `columns` from `other` (trimmed, blank → NULL), overwriting; rows without a partner get NULL and matched = false."""
    slim = other.select(on, *[blank_to_null(F.col(c)).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(slim, on, "left")
    return joined.withColumns({**{c: F.col(f"_n_{c}") for c in columns}, "matched": F.coalesce("_hit", F.lit(False))}).drop("_hit", *[f"_n_{c}" for c in columns])


def split_list(text: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), collapse_spaces), lambda x: x != "")


def explode_list_dimension(df: DataFrame, item: str, column: str, dim_ns: uuid.UUID, link_ns: uuid.UUID, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """A comma list → (dimension id+name, bridge id+item+dimension id); spellings differing in case are one value, the first seen names it."""
    parts = df.select(item, F.posexplode(split_list(F.col(column), separator)).alias("_pos", "name")).withColumn("_key", F.lower("name"))
    dims = first_per_key(parts.select("_key", "name", item, "_pos"), ["_key"], [item, "_pos"]).select(uuid5(dim_ns, F.col("_key")).alias("id"), "name")
    pairs = parts.select(item, "_key").distinct().withColumn("dim_id", uuid5(dim_ns, F.col("_key")))
    link = uuid5(link_ns, F.concat_ws(":", F.col(item).cast("string"), "dim_id"))
    return dims, pairs.select(link.alias("id"), item, "dim_id")


def first_spelling(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Rows whose text was not seen before, ignoring case. Texts are grouped by digest."""
    return first_per_key(df.withColumn("_key", F.sha2(F.lower(text), 256)), ["_key"], order).drop("_key")


def category_suffix(text: Column, known: tuple[str, ...] = KNOWN_SUGARS) -> Column:
    """First known value the text ends with; list longer values first."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.coalesce(*[F.when(F.endswith(low, F.lit(value)), value) for value in known])


def payload_values(payloads: DataFrame, known: tuple[str, ...] = KNOWN_SUGARS) -> DataFrame:
    """(slug, color, temperature, alcohol, alcohol_max, category) → clean shade, serving_temperature, alcohol, sugar.

    Implausible strengths and temperatures become NULL and are named in `suspicious`.
    """
    rows = payloads.select(
        "slug", blank_to_null(F.col("color")).alias("shade"), format_temperature(F.col("temperature")).alias("_t"),
        format_percent_range(F.col("alcohol").try_cast("double"), F.col("alcohol_max").try_cast("double")).alias("_a"), category_suffix(F.col("category"), known).alias("sugar"),
    )
    odd_a, odd_t = F.col("_a").isNotNull() & ~plausible(F.col("_a"), CATALOG_ALCOHOL), F.col("_t").isNotNull() & ~plausible(F.col("_t"), TEMPERATURE)
    return rows.withColumns({
        "alcohol": F.when(~odd_a, F.col("_a")), "serving_temperature": F.when(~odd_t, F.col("_t")),
        "suspicious": F.array_compact(F.array(F.when(odd_a, F.concat(F.lit("alcohol="), "_a")), F.when(odd_t, F.concat(F.lit("serving_temperature="), "_t")))),
    }).drop("_a", "_t")


PAYLOAD_FIELDS = ("shade", "serving_temperature", "alcohol", "sugar")


def fill_missing(items: DataFrame, values: DataFrame, fields: tuple[str, ...] = PAYLOAD_FIELDS) -> DataFrame:
    """Fill only empty fields from payload values by slug; `filled` and `missing` list the fields."""
    slim = values.select("slug", *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = items.join(slim, "slug", "left")
    empty = {f: F.col(f).isNull() | (F.trim(f) == "") for f in fields}
    joined = joined.withColumn("filled", F.array_compact(F.array(*[F.when(empty[f] & F.col(f"_n_{f}").isNotNull(), f) for f in fields])))
    joined = joined.withColumns({f: F.when(empty[f], F.col(f"_n_{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"_n_{f}" for f in fields])
    return joined.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fields])))


def fill_missing_links(items: DataFrame, links: DataFrame, offered: DataFrame, item: str, dim_ns: uuid.UUID, link_ns: uuid.UUID) -> DataFrame:
    """Linked values (dishes) for items that have none yet. `offered`: (item, pos, name), possibly repeated."""
    bare = offered.join(items.join(links, item, "left_anti").select(item), item, "left_semi").withColumn("name", collapse_spaces(F.col("name"))).filter("name <> ''")
    key = F.lower("name")
    pairs = bare.withColumn("_key", key).select(item, "_key").distinct().withColumn("dim_id", uuid5(dim_ns, F.col("_key")))
    return pairs.select(uuid5(link_ns, F.concat_ws(":", F.col(item).cast("string"), "dim_id")).alias("id"), item, "dim_id")


# --- phrase tagging ---------------------------------------------------------------------------------
def pick_spans(hits: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """Longest phrases first; per entity its first span that overlaps nothing chosen. (key, entity, phrase_id, start, end).

    Hits are gathered per text: their number is bounded by the text, which is one row anyway.
    """
    chars = F.length(F.array_join("phrase", " "))
    info = phrases.select("phrase_id", "entity", (-F.size("phrase")).alias("l"), (-chars).alias("c"))
    spans = hits.join(info, "phrase_id")
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("l", "c", "phrase_id", "start", "end", "entity"))).alias("_s"))
    none = F.filter("_s", lambda s: F.lit(False))

    def take(chosen: Column, s: Column) -> Column:
        clash = F.exists(chosen, lambda o: (o["entity"] == s["entity"]) | ((s["start"] < o["end"]) & (o["start"] < s["end"])))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(s)))

    picked = listed.select(key, F.explode(F.aggregate("_s", none, take)).alias("x"))
    return picked.select(key, "x.entity", "x.phrase_id", "x.start", "x.end")


def tag_phrases(texts: DataFrame, dictionary: DataFrame, key: str, text: str, links: DataFrame | None = None, excluded: list[str] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """New (text, entity) links found by dictionary phrases. `dictionary`: (entity, spelling); `excluded` names stay out.

    Of phrases of equal length the one with the smaller MD5 of "entity:phrase" comes first. With a dictionary of one block only what is chosen leaves
    the worker that reads the text; hits of several blocks are gathered per text.
    """
    names = dictionary.select("entity", match_text(F.col("spelling")).alias("_n")).filter(F.col("_n") != "")
    if excluded:
        names = names.filter(~F.col("_n").isin(*excluded))
    phrases = names.select(F.md5(F.concat_ws(":", F.col("entity").cast("string"), "_n")).alias("phrase_id"), "entity", F.split("_n", " ").alias("phrase")).dropDuplicates(["phrase_id"])
    words = F.filter(F.split("_n", " "), lambda t: t != "")
    tokened = spread(texts.select(key, text)).select(key, match_text(F.col(text)).alias("_n")).select(key, words.alias("tokens"))
    found = chosen_phrases(tokened, phrases, key, block_bytes=block_bytes)
    if found is None:
        found = pick_spans(phrase_places(tokened, phrases, key, block_bytes=block_bytes), phrases, key)
    return found if links is None else found.join(links, [key, "entity"], "left_anti")


# --- aliases ----------------------------------------------------------------------------------------
def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-zа-яё]+)"), 1)


def word_dictionary(pairs: DataFrame, manual: dict[str, str] = MANUAL_WORDS) -> DataFrame:
    """Word → label spelling learned from aligned (name, alias, ord) pairs where plain transliteration fails; manual words win."""
    aligned = pairs.select("ord", latin_words(F.col("name")).alias("a"), latin_words(F.col("alias")).alias("b"))
    aligned = aligned.filter((F.size("a") == F.size("b")) & F.forall("a", lambda w: w.rlike("^[а-яё]+$")))
    words = aligned.select("ord", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z")).select("ord", "pos", F.col("z.a").alias("word"), F.col("z.b").alias("spelling"))
    learned = first_per_key(words.filter((F.length("word") > 2) & (ru_to_lat(F.col("word")) != F.col("spelling"))), ["word"], ["ord", "pos"]).select("word", "spelling")
    fixed = pairs.sparkSession.createDataFrame(list(manual.items()), "word string, spelling string")
    return learned.join(F.broadcast(fixed), "word", "left_anti").unionByName(fixed)  # the manual list is a few words


def derive_aliases(names: DataFrame, words: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New aliases (key, alias) for names with at least one dictionary word; other words are transliterated; existing ones kept apart."""
    parts = names.select(key, F.posexplode(latin_words(F.col("name"))).alias("pos", "word")).join(words, "word", "left")
    put = F.coalesce("spelling", ru_to_lat(F.col("word")))
    built = parts.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", put.alias("w")))), lambda x: x["w"]), " ").alias("alias"), F.count("spelling").alias("_known")
    )  # words of one name
    fresh = built.filter("_known > 0").select(key, F.initcap("alias").alias("alias")).withColumn("_low", F.lower("alias"))
    return fresh.join(existing.select(key, F.lower("alias").alias("_low")), [key, "_low"], "left_anti").drop("_low")


def replace_placeholder(rows: DataFrame, dims: DataFrame, resolved: DataFrame, item: str, dim: str, placeholder: str, aliases: dict[str, str], ns: uuid.UUID) -> tuple[DataFrame, DataFrame]:
    """Point rows at the real dimension instead of the placeholder one: (rows, dimension).

    Resolved names go through the alias map, then match existing names ignoring case, else become new
    dimension rows. Unresolved rows stay; the placeholder row goes once nothing points at it.
    """
    is_unknown = F.lower(F.trim("name")) == placeholder.lower()
    unknown = dims.filter(is_unknown).select(F.col("id").alias(dim))
    known = dims.filter(~is_unknown).groupBy(F.lower(F.trim("name")).alias("_key")).agg(F.max("id").alias("_id"))
    name = F.trim("resolved")
    mapping = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])
    wanted = resolved.select(item, F.coalesce(F.element_at(mapping, F.lower(name)), name).alias("_name")).filter("_name <> ''").withColumn("_key", F.lower("_name"))
    target = rows.join(unknown, dim, "left_semi").join(wanted, item).join(known, "_key", "left")
    target = target.withColumn("_to", F.coalesce("_id", uuid5(ns, F.col("_key"))))
    created = first_per_key(target.filter("_id IS NULL").select("_to", "_name", item), ["_to"], [item]).select(F.col("_to").alias("id"), F.col("_name").alias("name"))
    out = rows.join(target.select(item, "_to"), item, "left").withColumn(dim, F.coalesce("_to", dim)).drop("_to")
    used = out.select(F.col(dim).alias("id")).distinct()
    kept = dims.filter(~is_unknown).unionByName(dims.filter(is_unknown).join(used, "id", "left_semi"))
    return out, kept.unionByName(created)


# --- glossary pages ---------------------------------------------------------------------------------
@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML character references to characters."""
    return text.map(lambda value: None if value is None else html.unescape(value))


def clean_text(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), "\\s+", " "))
    return F.regexp_replace(plain, "\\.{2,}(?=\\s|$)", ".")


def extract_glossary(
    pages: DataFrame, key: str, markup: str, namespace: uuid.UUID,
    heading: str = "<div[^>]*h2-heading[^>]*>(.*?)</div>", entry: str = "<p[^>]*>\\s*<strong[^>]*>(.*?)</strong>(.*?)</p>", section: str | None = "<section[^>]*lexicon-items[^>]*>(.*)</section>",
) -> DataFrame:
    """Letter headings and `term – definition` paragraphs → (id, term, letter, definition), first spelling of a term wins.

    `heading` has one group, `entry` two (term, definition).
    """
    body = F.regexp_extract(markup, f"(?s){section}", 1) if section else F.col(markup)
    block = f"(?s)({heading}|{entry})"
    found = pages.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(block), 1)).alias("pos", "block"))
    strip = lambda c: F.regexp_replace(c, "<[^>]*>", "")
    term, definition = F.regexp_extract("block", f"(?s)^{entry}$", 1), F.regexp_extract("block", f"(?s)^{entry}$", 2)
    rows = found.select(key, "pos", strip(F.regexp_extract("block", f"(?s)^{heading}$", 1)).alias("_head"), strip(term).alias("_term"), strip(definition).alias("_def"))
    seen = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # blocks of one page
    rows = rows.withColumn("_letter", F.last(F.when(F.col("_head") != "", F.trim("_head")), True).over(seen)).filter(F.col("_head") == "")
    rows = rows.withColumns({"term": clean_text(unescape("_term")), "definition": clean_text(F.regexp_replace(unescape("_def"), "^\\s*[-–—:]\\s*", ""))}).filter("term <> '' AND definition <> ''")
    rows = rows.withColumn("_key", F.replace(F.lower("term"), F.lit("ё"), F.lit("е")))
    first = first_per_key(rows.select("_key", "term", "definition", "_letter", key, "pos"), ["_key"], [key, "pos"])
    letter = F.when(F.coalesce("_letter", F.lit("")) != "", F.col("_letter")).otherwise(F.upper(F.substring("term", 1, 1)))
    return first.select(uuid5(namespace, F.col("_key")).alias("id"), "term", letter.alias("letter"), "definition")
