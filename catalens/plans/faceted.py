"""Faceted search over the part table: name, brand = producer, name words = grapes, type = colour, first word = sugar."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.operators import facets as f
from catalens.operators.rulebook import Dishes, Likes, Rule, RuleBook, Sign, said
from catalens.plans.registry import Tables, query

C = F.col

QUOTE = ("text says: [", "]")
PART_RULES = RuleBook(
    dishes={"metal": ("Metal work", ("ring", "bolt", "gear", "nut")), "light": ("Light work", ("widget", "lamp"))},
    tastes=(
        Sign("vivid", "Vivid", (said("red|blue|green", QUOTE),)), Sign("strong", "Strong", (said("large|hot", QUOTE), ("alcohol >= 20", "'size from 20'"))),
        Sign("weak", "Weak", (said("small|cold", QUOTE), ("alcohol <= 6", "'size up to 6'"))),
    ),
    sparkling_pattern="promo|small", sparkling_sugars=("hot", "red"), sparkling_word="sparkle", types={"sparkling": "Sparkling", "still": "Still"},
    occasions={
        "gift": ("As a gift", (Rule("rating >= 4.0", 2, "concat('rating ', format_string('%.2f', rating))"), Likes("vivid", 1), Rule("sparkling", 0.5, "'sparkling'"))),
        "daily": ("Every day", (Rule("NOT sparkling AND color IN ('ECONOMY', 'SMALL')", 1, "concat(lower(color), ' is fine')"), Dishes(("metal",), 1.5), Likes("weak", 0.5))),
        "party": ("Big party", (Rule("sparkling", 2, "'for all'"), Dishes(("light",), 1))),
    },
    sugar_order=("red", "blue", "green"), dish_reason="goes with: ",
)

SEARCHES = [
    f.Search(1, text="blue ring"), f.Search(2, occasion="gift", min_rating=2.0), f.Search(3, dishes=("metal",), tastes=("vivid",), colors=("ECONOMY", "SMALL")),
    f.Search(4, text="brand 12", types=("sparkling",), sort="rating"), f.Search(5, regions=("N1", "N2"), grapes=("ring", "gear"), occasion="daily", sort="name", limit=8, offset=4),
    f.Search(6, sugars=("red", "small"), occasion="party", limit=30),
]


NOUNS, ADJECTIVES, COLORS = ("ring", "bolt", "gear", "widget", "plate", "rod", "gizmo", "anvil"), ("blue", "red", "hot", "cold", "small", "large", "new", "old"), ("ECONOMY", "SMALL", "LARGE", "PROMO", "MEDIUM")


def grid_search(i: int) -> f.Search:
    """The i-th of a thousand searches that mix texts, occasions, filters, orders and pages."""
    noun, adjective, color = NOUNS[i % 8], ADJECTIVES[i // 8 % 8], COLORS[i % 5]
    return f.Search(
        i, text=(adjective, noun[:3], f"Brand#{1 + i % 25}", f"{adjective} {noun}", noun[1:], f"{noun} {adjective[:2]}", "", "", "", "", "")[i % 11], occasion=(None, "gift", "daily", "party", "nothing")[i % 5],
        dishes=(("metal",), ("light",), ("metal", color), (), (), (), ())[i % 7], tastes=(("vivid",), ("strong", "vivid"), (), (), (), (), (), (), ())[i % 9],
        types=(("sparkling",), ("still", "sparkling"), (), (), (), (), (), ())[i % 8], colors=((color, COLORS[(i + 1) % 5]), (color,), (), ())[i // 3 % 4], sugars=((adjective,), (), (), (), (), ())[i // 5 % 6],
        regions=(("N1", "N2", "N5"), (), (), (), ())[i // 2 % 5], grapes=((noun, "ring"), (), (), ())[i // 7 % 4], min_rating=(2.5, 0.3, None, None)[i // 11 % 4],
        sort=("relevance", "rating", "name")[i % 3], limit=3 + i % 8, offset=i % 4 * 2,
    )


GRID = [grid_search(i) for i in range(1000)]


def entries(spark, d):
    words = F.split("p_name", " ")
    p = Tables(spark, d).part.select(
        C("p_partkey").alias("item_id"), C("p_name").alias("name"), C("p_brand").alias("producer"), F.array(F.element_at(words, -1)).alias("grapes"),
        F.concat(F.lit("N"), (C("p_partkey") % 7).cast("string")).alias("region"), C("p_type").alias("color"), F.element_at(words, 1).alias("sugar"),
        C("p_size").cast("string").alias("alcohol"), C("p_name").alias("description"), F.array(F.element_at(words, -1), "p_type").alias("foods"),
        F.when(C("p_size") % 5 != 0, C("p_size") / 10.0).alias("rating"),
    )
    return f.with_occasions(f.prepare_entries(p, PART_RULES), PART_RULES)


METAL = "['ring', 'bolt', 'gear', 'nut']"
ENTRY_SQL = f"""b AS (SELECT p_partkey AS item_id, p_name AS name, p_brand AS producer, split_part(p_name, ' ', -1) AS grape, 'N' || (p_partkey % 7) AS region, p_type AS color, split_part(p_name, ' ', 1) AS sugar,
     p_size::DOUBLE AS size, CASE WHEN p_size BETWEEN 3 AND 25 THEN p_size END AS alcohol, coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size / 10.0 END, 0.0)::DOUBLE AS rating FROM part),
   c AS (SELECT *, sugar IN ('hot', 'red') OR regexp_matches(name, 'promo|small') AS sparkling, CASE WHEN list_contains({METAL}, grape) THEN 'metal' WHEN grape IN ('widget', 'lamp') THEN 'light' ELSE grape END AS dish,
       nullif(regexp_extract(name, 'red|blue|green'), '') AS vivid0, nullif(regexp_extract(name, 'large|hot'), '') AS strong0, nullif(regexp_extract(name, 'small|cold'), '') AS weak0 FROM b),
   e AS (SELECT *, trim(regexp_replace(lower(concat_ws(' ', name, producer, grape, region, color, sugar, CASE WHEN sparkling THEN 'sparkle' END)), '[^0-9a-z]+', ' ', 'g')) AS hay,
       'text says: [' || vivid0 || ']' AS vivid, CASE WHEN strong0 IS NOT NULL THEN 'text says: [' || strong0 || ']' WHEN alcohol >= 20 THEN 'size from 20' END AS strong,
       CASE WHEN weak0 IS NOT NULL THEN 'text says: [' || weak0 || ']' WHEN alcohol <= 6 THEN 'size up to 6' END AS weak FROM c),
   p AS (SELECT *, replace(replace(replace(replace(replace(hay, 'kh', 'h'), 'x', 'ks'), 'w', 'v'), 'j', 'i'), 'y', 'i') AS hay_latin,
       (rating >= 4.0)::INT * 2.0 + (vivid IS NOT NULL)::INT * 1.0 + sparkling::INT * 0.5 AS gift, (NOT sparkling AND color IN ('ECONOMY', 'SMALL'))::INT * 1.0 + (dish = 'metal')::INT * 1.5 + (weak IS NOT NULL)::INT * 0.5 AS daily,
       sparkling::INT * 2.0 + (dish = 'light')::INT * 1.0 AS party FROM e)"""


@query("search_entries", "C1,P11,P12", f"WITH {ENTRY_SQL} SELECT item_id, hay, hay_latin, sparkling, alcohol::DOUBLE AS alcohol, rating, dish || ',' || color AS dishes, vivid, strong, weak FROM p")
def _(spark, d):
    return entries(spark, d).select(
        "item_id", C("haystack").alias("hay"), C("haystack_latin").alias("hay_latin"), "sparkling", "alcohol", "rating", F.array_join("dishes", ",").alias("dishes"),
        *[F.element_at("tastes", t).alias(t) for t in ("vivid", "strong", "weak")],
    )


@query("occasion_points", "C3", f"WITH {ENTRY_SQL} SELECT item_id, gift::DOUBLE AS gift, daily::DOUBLE AS daily, party::DOUBLE AS party FROM p")
def _(spark, d):
    return entries(spark, d).select("item_id", *[F.element_at("occasions", k)["points"].alias(k) for k in PART_RULES.occasions])


TIER = """CASE WHEN NOT ({all_hay}) THEN 0 WHEN name = '{t}' THEN 100 WHEN starts_with(name, '{t}') THEN 60 WHEN {all_name} THEN 40 ELSE 20 END"""


def tier_sql(text: str) -> str:
    words = text.split()
    return TIER.format(
        t=text, all_hay=" AND ".join(f"(contains(hay, '{w}') OR contains(hay_latin, '{w}'))" for w in words), all_name=" AND ".join(f"contains(name, '{w}')" for w in words)
    )


@query("text_tiers", "C2", f"WITH {ENTRY_SQL} SELECT item_id, ({tier_sql('blue ring')})::DOUBLE AS tier, ({tier_sql('ring')})::DOUBLE AS one_word, ({tier_sql('brand 12')})::DOUBLE AS brand FROM p")
def _(spark, d):
    return entries(spark, d).select("item_id", f.text_tier("Blue RING!").alias("tier"), f.text_tier("ring").alias("one_word"), f.text_tier("Brand#12").alias("brand"))


def say(value) -> str:
    if isinstance(value, tuple):
        return f"[{', '.join(say(v) for v in value)}]::VARCHAR[]"
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def seen_sql(searches: list[f.Search]) -> str:
    """Every search against every entry, with the bits of what fails."""
    rows = ", ".join("(" + ", ".join(say(v) for v in (q.query_id, "".join(x if x.isalnum() else " " for x in q.text.lower()), q.occasion, q.dishes, q.tastes, q.types, q.colors, q.sugars, q.regions, q.grapes, q.min_rating, q.sort, q.limit, q.offset)) + ")" for q in searches)
    latin = lambda x: f"replace(replace(replace(replace(replace({x}, 'kh', 'h'), 'x', 'ks'), 'w', 'v'), 'j', 'i'), 'y', 'i')"
    bit = lambda dim, fails: f"CASE WHEN {fails} THEN {f.BITS[dim]} ELSE 0 END"
    chosen = lambda dim, value: bit(dim, f"len({dim}) > 0 AND NOT list_contains({dim}, {value})")
    masks = [
        bit("dishes", "len(list_filter(dishes, lambda x: x <> dish AND x <> color)) > 0"),
        bit("tastes", "(list_contains(tastes, 'vivid') AND vivid IS NULL) OR (list_contains(tastes, 'strong') AND strong IS NULL) OR (list_contains(tastes, 'weak') AND weak IS NULL)"),
        chosen("types", "CASE WHEN sparkling THEN 'sparkling' ELSE 'still' END"), chosen("colors", "color"), chosen("sugars", "sugar"), chosen("regions", "region"), chosen("grapes", "grape"),
        bit("rating", "rating < min_rating"), bit("occasions", "known AND pts < 2"),
    ]
    return f"""{ENTRY_SQL}, q0(query_id, norm, occasion, dishes, tastes, types, colors, sugars, regions, grapes, min_rating, sort, lim, off) AS (VALUES {rows}),
   q AS (SELECT *, coalesce(occasion IN ('gift', 'daily', 'party'), false) AS known, list_filter(string_split(norm, ' '), lambda x: x <> '') AS toks FROM q0),
   x0 AS (SELECT p.*, q.*, CASE occasion WHEN 'gift' THEN gift WHEN 'daily' THEN daily WHEN 'party' THEN party ELSE 0 END AS pts,
     CASE WHEN len(toks) = 0 THEN 0 WHEN name = norm THEN 100 WHEN starts_with(name, norm) THEN 60
       WHEN len(list_filter(toks, lambda t: NOT (contains(name, t) OR contains({latin('name')}, {latin('t')})))) = 0 THEN 40 ELSE 20 END AS txt
     FROM p, q WHERE len(list_filter(toks, lambda t: NOT (contains(hay, t) OR contains(hay_latin, {latin('t')})))) = 0),
   seen AS (SELECT *, {' + '.join(masks)} AS mask FROM x0),
   why AS (SELECT *, txt + pts AS score, list_filter(list_concat(
       CASE occasion WHEN 'gift' THEN [CASE WHEN rating >= 4 THEN 'rating ' || printf('%.2f', rating) END, 'vivid — ' || vivid, CASE WHEN sparkling THEN 'sparkling' END]
         WHEN 'daily' THEN [CASE WHEN NOT sparkling AND color IN ('ECONOMY', 'SMALL') THEN lower(color) || ' is fine' END, CASE WHEN dish = 'metal' THEN 'goes with: metal work' END, 'weak — ' || weak]
         WHEN 'party' THEN [CASE WHEN sparkling THEN 'for all' END, CASE WHEN dish = 'light' THEN 'goes with: light work' END] ELSE [] END,
       [CASE WHEN len(dishes) > 0 THEN 'goes with: ' || lower(array_to_string(list_transform(dishes, lambda g: CASE g WHEN 'metal' THEN 'Metal work' WHEN 'light' THEN 'Light work' ELSE g END), ', ')) END],
       list_transform(tastes, lambda t: CASE t WHEN 'vivid' THEN 'vivid — ' || vivid WHEN 'strong' THEN 'strong — ' || strong ELSE 'weak — ' || weak END)), lambda x: x IS NOT NULL) AS told FROM seen WHERE mask = 0),
   hits AS (SELECT * EXCLUDE (told), list_filter(told, lambda r, i: list_position(told, r) = i) AS told FROM why)"""


#: CRC-32 of the id, bit by bit: the fixed order of ties.
CRC = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(item_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"


def pages_sql(searches: list[f.Search], columns: str) -> str:
    return f"""WITH {seen_sql(searches)}, crc AS (SELECT item_id AS crc_id, {CRC} AS shuffle FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN sort = 'name' THEN name END, CASE WHEN sort = 'relevance' THEN -score END,
      CASE WHEN sort <> 'name' THEN -rating END, CASE WHEN sort = 'relevance' THEN -len(told) END, shuffle, item_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM hits JOIN crc ON crc_id = item_id)
      SELECT query_id, rank, {columns} FROM r WHERE rank > off AND rank <= off + lim"""


def table(spark, searches):
    return f.search_table(spark, searches)


def seen(spark, d, searches=SEARCHES):
    return f.examine(entries(spark, d), table(spark, searches), PART_RULES)


@query("search_hits", "C3,C4,P4", f"WITH {seen_sql(SEARCHES)} SELECT query_id, item_id, score::DOUBLE AS score, array_to_string(told, '; ') AS reasons FROM hits")
def _(spark, d):
    return f.matches(seen(spark, d)).select("query_id", "item_id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query("search_result_scores", "C7,T1,T2,A13", pages_sql(SEARCHES, "round(score::DOUBLE, 2) AS score, total, name"))
def _(spark, d):
    return f.search_pages(entries(spark, d), table(spark, SEARCHES), PART_RULES).select("query_id", "rank", "score", "total", "name")


PAGE = "item_id, name, round(score::DOUBLE, 2) AS score, array_to_string(told, '; ') AS reasons, total"


@query("search_pages", "C7,F12", pages_sql(SEARCHES, PAGE))
def _(spark, d):
    return f.search_pages(entries(spark, d), table(spark, SEARCHES), PART_RULES).withColumn("reasons", F.array_join("reasons", "; "))


@query("many_search_pages", "C2,C3,C4,C7", pages_sql(GRID, PAGE))
def _(spark, d):
    return f.search_pages(entries(spark, d), table(spark, GRID), PART_RULES).withColumn("reasons", F.array_join("reasons", "; "))


def facets_sql(searches: list[f.Search]) -> str:
    but = lambda dim: f"mask IN (0, {f.BITS[dim]})"
    return f"""WITH {seen_sql(searches)}, raw AS (
    SELECT query_id, 'types' AS dim, CASE WHEN sparkling THEN 'sparkling' ELSE 'still' END AS value FROM seen WHERE {but('types')}
    UNION ALL SELECT query_id, 'colors', color FROM seen WHERE {but('colors')} UNION ALL SELECT query_id, 'sugars', sugar FROM seen WHERE {but('sugars')}
    UNION ALL SELECT query_id, 'regions', region FROM seen WHERE {but('regions')} UNION ALL SELECT query_id, 'grapes', grape FROM seen WHERE {but('grapes')}
    UNION ALL SELECT query_id, 'dishes', unnest([dish, color]) FROM seen WHERE mask = 0
    UNION ALL SELECT query_id, 'tastes', unnest(list_filter([CASE WHEN vivid IS NOT NULL THEN 'vivid' END, CASE WHEN strong IS NOT NULL THEN 'strong' END, CASE WHEN weak IS NOT NULL THEN 'weak' END], lambda x: x IS NOT NULL)) FROM seen WHERE mask = 0
    UNION ALL SELECT query_id, 'occasions', unnest(list_filter([CASE WHEN gift >= 2 THEN 'gift' END, CASE WHEN daily >= 2 THEN 'daily' END, CASE WHEN party >= 2 THEN 'party' END], lambda x: x IS NOT NULL)) FROM seen WHERE {but('occasions')}),
  n AS (SELECT query_id, dim, value, count(*) AS n FROM raw GROUP BY ALL),
  o AS (SELECT 'colors' AS dim, color AS value, color AS label, 0 AS pos FROM p GROUP BY color UNION ALL SELECT 'grapes', grape, grape, 0 FROM p GROUP BY grape
    UNION ALL SELECT 'regions', region, region, -count(*) FROM p GROUP BY region
    UNION ALL SELECT 'sugars', sugar, sugar, CASE sugar WHEN 'red' THEN 0 WHEN 'blue' THEN 1 WHEN 'green' THEN 2 ELSE 3 END FROM p GROUP BY sugar
    UNION ALL (VALUES ('occasions', 'gift', 'As a gift', 0), ('occasions', 'daily', 'Every day', 0), ('occasions', 'party', 'Big party', 0), ('dishes', 'metal', 'Metal work', 0), ('dishes', 'light', 'Light work', 0),
       ('tastes', 'vivid', 'Vivid', 0), ('tastes', 'strong', 'Strong', 0), ('tastes', 'weak', 'Weak', 0), ('types', 'sparkling', 'Sparkling', 0), ('types', 'still', 'Still', 1))),
  full_o AS (SELECT q.query_id, o.*, coalesce(n.n, 0) AS n FROM o CROSS JOIN (SELECT query_id FROM q) q LEFT JOIN n ON n.query_id = q.query_id AND n.dim = o.dim AND n.value = o.value)
  SELECT query_id::INTEGER AS query_id, dim, row_number() OVER (PARTITION BY query_id, dim ORDER BY CASE WHEN dim = 'grapes' THEN -n WHEN dim IN ('regions', 'sugars', 'types') THEN pos ELSE 0 END, lower(label), label) AS place, value, label, n FROM full_o"""


@query("facet_counts", "C6,A10", facets_sql(SEARCHES))
def _(spark, d):
    e = entries(spark, d)
    return f.facet_counts(e, f.examine_alike(e, table(spark, SEARCHES), PART_RULES), table(spark, SEARCHES), PART_RULES)


@query("many_facet_counts", "C6", facets_sql(GRID))
def _(spark, d):
    e = entries(spark, d)
    return f.facet_counts(e, f.examine_alike(e, table(spark, GRID), PART_RULES), table(spark, GRID), PART_RULES)


@query("corrected_searches", "C5,F9")
def _(spark, d):
    e = entries(spark, d)
    names = Tables(spark, d).part.select("p_name").distinct()
    noisy = F.replace(F.replace("p_name", F.lit("i"), F.lit("ii")), F.lit("ol"), F.lit("lo"))
    texts = names.select(F.xxhash64("p_name").alias("query_id"), noisy.alias("text"), "p_name")
    return f.correct_texts(e, texts).join(texts, "query_id").select(C("text").alias("typed"), "corrected", "p_name")


@query("corrected_word_prefixes", "C5 prefix part", "WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS known FROM part), w AS (SELECT DISTINCT substr(known, 1, 3) AS word FROM v) SELECT word FROM w WHERE EXISTS (SELECT 1 FROM v WHERE starts_with(known, word))")
def _(spark, d):
    e = entries(spark, d)
    words = Tables(spark, d).part.select(F.explode(F.split("p_name", " ")).alias("w")).select(F.substring("w", 1, 3).alias("word")).distinct()
    texts = words.select(F.xxhash64("word").alias("query_id"), C("word").alias("text"))
    return f.correct_texts(e, texts).join(texts, "query_id").filter(C("corrected") == C("text")).select(C("text").alias("word"))
