"""Glossary: term index, annotation of free text, term search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.text import ENDINGS, EXACT_ONLY_TERMS, WORD_PATTERN, glossary_form, term_stems
from catalens.operators.dictionary import BLOCK_BYTES, first_terms, term_places
from catalens.session import spread

def term_index(terms: DataFrame) -> DataFrame:
    """(term_id, term) → stems, exact-only flag and the order in which terms are tried: long phrases first, then by term."""
    form = glossary_form(F.col("term"))
    rows = terms.select("term_id", "term", term_stems(F.col("term")).alias("stems"), form.isin(*EXACT_ONLY_TERMS).alias("exact"))
    return rows.withColumn("letter", F.upper(F.substring("term", 1, 1)))


def glossary_forms(texts: DataFrame, key: str, text: str) -> DataFrame:
    return spread(texts.select(key, text)).select(key, glossary_form(F.col(text)).alias("_form"))


def term_hits(texts: DataFrame, index: DataFrame, key: str, text: str, endings: tuple[str, ...] = ENDINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every place where a term may stand: (key, term_id, pos, words, start, end), see `term_places`."""
    return term_places(glossary_forms(texts, key, text), index, key, "_form", WORD_PATTERN, endings, block_bytes)


def annotate_terms(texts: DataFrame, terms: DataFrame, key: str, text: str, endings: tuple[str, ...] = ENDINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """First mention of each term per text, left to right without overlaps: (key, term_id, start, end) in characters.

    With an index of one block only what is chosen leaves the worker that reads the text; candidates of several blocks are gathered per text, bounded by it.
    """
    chosen = first_terms(glossary_forms(texts, key, text), terms, key, "_form", WORD_PATTERN, endings, block_bytes)
    if chosen is not None:
        return chosen
    order = terms.select("term_id", (-F.size("stems")).alias("_len"), "term")
    ranked = term_hits(texts, terms, key, text, endings, block_bytes).join(order, "term_id")
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("pos", "_len", "term", "term_id", "words", "start", "end"))).alias("_c"))
    begin = F.struct(F.lit(0).alias("next"), F.filter("_c", lambda x: F.lit(False)).alias("got"))

    def take(acc: Column, c: Column) -> Column:
        clash = (c["pos"] < acc["next"]) | F.exists(acc["got"], lambda g: g["term_id"] == c["term_id"])
        return F.when(clash, acc).otherwise(F.struct((c["pos"] + c["words"]).alias("next"), F.concat(acc["got"], F.array(c)).alias("got")))

    return listed.select(key, F.explode(F.aggregate("_c", begin, take, lambda acc: acc["got"])).alias("x")).select(key, "x.term_id", "x.start", "x.end")


def segments(texts: DataFrame, notes: DataFrame, key: str, text: str) -> DataFrame:
    """Text cut into plain and annotated pieces in order: (key, pieces array<struct<text, term_id>>)."""
    listed = notes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "term_id"))).alias("_n"))
    kind = notes.schema["term_id"].dataType
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<text:string,term_id:{kind.simpleString()}>>").alias("out"))
    piece = lambda a, b, t: F.struct(F.substring(F.col(text), a + 1, b - a).alias("text"), t.cast(kind).alias("term_id"))

    def add(acc: Column, n: Column) -> Column:
        plain = F.when(n["start"] > acc["at"], F.array(piece(acc["at"], n["start"], F.lit(None)))).otherwise(F.filter(acc["out"], lambda x: F.lit(False)))
        return F.struct(n["end"].alias("at"), F.concat(acc["out"], plain, F.array(piece(n["start"], n["end"], n["term_id"]))).alias("out"))

    def finish(acc: Column) -> Column:
        rest = F.length(text) - acc["at"]
        tail = F.array(piece(acc["at"], F.length(text), F.lit(None)))
        return F.when(rest > 0, F.concat(acc["out"], tail)).otherwise(acc["out"])

    none = F.array().cast(f"array<struct<start:int,end:int,term_id:{kind.simpleString()}>>")
    joined = texts.select(key, text).join(listed, key, "left").withColumn("_n", F.coalesce("_n", none))
    return joined.select(key, F.aggregate("_n", begin, add, finish).alias("pieces"))


def search_terms(terms: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Terms starting with the query first, then those containing it."""
    form, needle = glossary_form(F.col("term")), glossary_form(F.lit(query.strip()))
    hits = terms.filter((F.lit(query.strip()) != "") & F.contains(form, needle))
    return hits.orderBy(~F.startswith(form, needle), "term", "term_id").limit(limit)


def term_detail(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """Details of the asked ids; unknown ids give NULLs."""
    return ids.join(terms, "term_id", "left")
