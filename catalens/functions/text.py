"""Text normalisation, transliteration, stemming and token windows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: they decide the normalised form -----------------------------------------------
LATIN_LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}
CONFUSABLES = {"а": "a", "о": "o", "с": "c", "р": "p", "е": "e"}
RU_TO_LAT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# search spelling: a second, coarser table plus ordered merges of common variants
RU_TO_SEARCH_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "yu", "я": "ya",
}
SEARCH_LATIN_MERGES = (("kh", "h"), ("x", "ks"), ("w", "v"), ("j", "i"), ("y", "i"))
ENDINGS = (
    "а", "я", "о", "е", "ы", "и", "у", "ю", "ь", "й",
    "ам", "ям", "ах", "ях", "ов", "ев", "ей", "ой", "ом", "ем", "ою", "ею",
    "ая", "яя", "ое", "ее", "ые", "ие", "ый", "ий", "ым", "им", "ых", "их", "ую", "юю",
    "ами", "ями", "ого", "его", "ому", "ему", "ыми", "ими",
)
EXACT_ONLY_TERMS = ("балк", "корк")
MIN_STEM = 3
WORD_PATTERN = "[a-zа-я0-9]+(?:-[a-zа-я0-9]+)*"
# --------------------------------------------------------------------------------------------------

# Our own reverse table: the multi-letter spellings of RU_TO_LAT first, then single letters.
LAT_TO_RU_DIGRAPHS = sorted(
    ((lat, ru) for ru, lat in RU_TO_LAT.items() if len(lat) > 1), key=lambda pair: (-len(pair[0]), pair[0])
)
LAT_TO_RU_LETTERS = {lat: ru for ru, lat in reversed(RU_TO_LAT.items()) if len(lat) == 1}


def _latin_diacritics() -> tuple[str, str]:
    """Lower-case letters U+00C0..U+024F that decompose to one base letter, and that letter."""
    source, target = [], []
    for code in range(0x00C0, 0x0250):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


DIACRITICS = _latin_diacritics()


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it."""
    return text.map(lambda value: None if value is None else unicodedata.normalize("NFKC", value))


def needs_nfkc(text: Column) -> Column:
    """True when a string holds anything beyond plain Latin/Cyrillic letters, so NFKC may change it."""
    return text.rlike("[^\\u0000-\\u009f\\u00a1-\\u00a7\\u00a9\\u00ab-\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u0180-\\u01c3\\u0400-\\u052f\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u20ac]")


def _replace_all(text: Column, pairs) -> Column:
    for source, target in pairs:
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def _letter_map(text: Column, table: dict[str, str]) -> Column:
    """Per-letter table: longer targets by replace, single letters and deletions by one translate."""
    text = _replace_all(text, [(k, v) for k, v in table.items() if len(v) > 1])
    single = {k: v for k, v in table.items() if len(v) == 1}
    removed = "".join(k for k, v in table.items() if not v)
    return F.translate(text, "".join(single) + removed, "".join(single.values()))


def squeeze_words(text: Column, keep: str) -> Column:
    """Everything outside the class `keep` becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[^{keep}]+", " "))


def normalize_match_text(text: Column) -> Column:
    """Comparable form of a label text. NULL becomes ''. Inputs are expected in NFKC; `match_text` brings them there."""
    text = F.lower(F.coalesce(text, F.lit("")))
    text = _replace_all(text, [(k, v) for k, v in LATIN_LIGATURES.items() if len(v) > 1])
    single = {k: v for k, v in LATIN_LIGATURES.items() if len(v) == 1}
    text = F.translate(text, DIACRITICS[0] + "".join(single), DIACRITICS[1] + "".join(single.values()))
    text = F.translate(text, "ё" + "".join(CONFUSABLES), CONFUSABLES["е"] + "".join(CONFUSABLES.values()))
    return squeeze_words(text, "0-9a-zа-я")


def folded(text: Column, flag: Column | None = None) -> Column:
    """NFKC form of a text. Only texts that need it (`flag`) travel to the Arrow UDF, the others go as NULL."""
    flag = needs_nfkc(text) if flag is None else flag
    return F.coalesce(nfkc(F.when(flag, text)), text)


def match_text(text: Column) -> Column:
    """`normalize_match_text` including NFKC. Holds a UDF, so it can't stand inside a lambda or an aggregate."""
    return normalize_match_text(folded(text))


def ru_to_lat(text: Column) -> Column:
    return _letter_map(F.lower(text), RU_TO_LAT)


def lat_to_ru(text: Column) -> Column:
    text = _replace_all(F.lower(text), LAT_TO_RU_DIGRAPHS)
    return F.translate(text, "".join(LAT_TO_RU_LETTERS), "".join(LAT_TO_RU_LETTERS.values()))


def text_variants(text: Column) -> Column:
    """Distinct normalised spellings: as is, Cyrillic→Latin, Latin→Cyrillic (of the raw text, NFKC after that)."""
    flag = needs_nfkc(text)
    variants = F.array(*[normalize_match_text(folded(spelling, flag)) for spelling in (text, ru_to_lat(text), lat_to_ru(text))])
    return F.array_distinct(F.filter(variants, lambda v: v != ""))


def normalize_query(text: Column) -> Column:
    text = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))
    return squeeze_words(text, "0-9a-zа-я")


def to_search_latin(text: Column) -> Column:
    return _replace_all(_letter_map(text, RU_TO_SEARCH_LATIN), SEARCH_LATIN_MERGES)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def stem(word: Column) -> Column:
    """Cut the longest listed ending if at least three letters remain."""
    endings = "|".join(sorted(ENDINGS, key=lambda e: (-len(e), e)))
    return F.regexp_replace(word, f"^(.{{{MIN_STEM},}}?)(?:{endings})$", "$1")


def glossary_form(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def term_stems(term: Column) -> Column:
    phrase = F.regexp_replace(glossary_form(term), "\\([^)]*\\)", " ")
    return F.transform(F.regexp_extract_all(phrase, F.lit(f"({WORD_PATTERN})"), 1), stem)


def word_windows(toks: Column, size: Column | int, separator: str = " ") -> Column:
    """All runs of `size` neighbouring tokens, joined."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.size(toks) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, size), separator))


def bigram_glue(toks: Column) -> Column:
    """Neighbouring tokens glued together."""
    return word_windows(toks, 2, "")


def strip_think(text: Column) -> Column:
    """Drop a leading reasoning block of a model answer."""
    return F.trim(F.regexp_replace(text, "(?s)^\\s*<think>.*?</think>", ""))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)
