"""SQL fragments for the oracle side: the same text rules said in DuckDB's own functions."""

from __future__ import annotations

from catalens.functions import text as t


def _replace(expr: str, pairs) -> str:
    for source, target in pairs:
        expr = f"replace({expr}, '{source}', '{target}')"
    return expr


def match_text(expr: str) -> str:
    lowered = _replace(f"lower(coalesce({expr}, ''))", [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i")])
    plain = f"translate(strip_accents({lowered}), 'аосре', 'aocpe')"
    return f"trim(regexp_replace({plain}, '[^0-9a-zа-я]+', ' ', 'g'))"


def query_text(expr: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({expr}, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


def search_latin(expr: str) -> str:
    return _replace(expr, t.SEARCH_LATIN_MERGES)


def ru_letters(expr: str) -> str:
    expr = _replace(f"lower({expr})", t.LAT_TO_RU_DIGRAPHS)
    return f"translate({expr}, '{''.join(t.LAT_TO_RU_LETTERS)}', '{''.join(t.LAT_TO_RU_LETTERS.values())}')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda x: x <> '')"


def stem(expr: str) -> str:
    endings = "|".join(sorted(t.ENDINGS, key=lambda e: (-len(e), e)))
    return f"regexp_replace({expr}, '^(.{{3,}}?)(?:{endings})$', '\\1')"


def uuid5(namespace_hex: str, expr: str) -> str:
    digest = f"sha1(unhex('{namespace_hex}') || encode({expr}))"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )
