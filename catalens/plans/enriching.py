"""Enrichment and glossary over parts, orders, documents, benchmark and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalens.functions import text as t
from catalens.functions import values as v
from catalens.operators import enrichment as n
from catalens.operators import glossary as g
from catalens.operators.dictionary import phrase_places
from catalens.plans import sqltext as q
from catalens.plans.registry import Tables, query
from catalens.session import spread

C = F.col
DIM, LINK = uuid.uuid5(uuid.NAMESPACE_URL, "catalens/dim"), uuid.uuid5(uuid.NAMESPACE_URL, "catalens/link")
EN_ENDINGS = ("s", "ing", "ed", "er", "tion", "th", "re")


@query("filled_from_dump", "N1", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN nullif(trim(replace(c_mktsegment, 'MACHINERY', '  ')), '') END AS shade, c_custkey IS NOT NULL AS matched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey")
def _(spark, d):
    x = Tables(spark, d)
    other = x.customer.filter("c_custkey % 4 <> 0").select(C("c_custkey").alias("o_custkey"), F.concat(F.lit(" "), F.replace("c_mktsegment", F.lit("MACHINERY"), F.lit("  "))).alias("shade"))
    return n.fill_from(x.orders.select("o_orderkey", "o_custkey", "o_orderpriority").withColumnRenamed("o_orderpriority", "shade"), other, "o_custkey", ["shade"]).select("o_orderkey", "shade", "matched")


LIST = "src AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END || ' ,  ' || split_part(p_name, ' ', 2) || ',' || p_type || ' ' || p_brand || ', ' AS lst FROM part), parts AS (SELECT p_partkey, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS name, pos FROM (SELECT p_partkey, unnest(string_split(lst, ',')) AS x, unnest(range(0, 4)) AS pos FROM src) WHERE trim(x) <> '')"


def listed(spark, d):
    w = F.split("p_name", " ")
    first = F.when(C("p_partkey") % 3 == 0, F.upper(w[0])).otherwise(w[0])
    return Tables(spark, d).part.select("p_partkey", F.concat(first, F.lit(" ,  "), w[1], F.lit(","), "p_type", F.lit(" "), "p_brand", F.lit(", ")).alias("lst"))


@query("list_dimension", "N2,F11", f"WITH {LIST} SELECT {q.uuid5(DIM.hex, 'k')} AS id, name FROM (SELECT lower(name) AS k, arg_min(name, p_partkey * 10 + pos) AS name FROM parts GROUP BY 1)")
def _(spark, d):
    return n.explode_list_dimension(listed(spark, d), "p_partkey", "lst", DIM, LINK)[0]


@query("list_bridge", "N2,F11", f"WITH {LIST}, b AS (SELECT DISTINCT p_partkey, {q.uuid5(DIM.hex, 'lower(name)')} AS dim_id FROM parts) SELECT {q.uuid5(LINK.hex, 'p_partkey || chr(58) || dim_id')} AS id, p_partkey, dim_id FROM b")
def _(spark, d):
    return n.explode_list_dimension(listed(spark, d), "p_partkey", "lst", DIM, LINK)[1]


FMT = "regexp_replace(regexp_replace(printf('%.4f', {x}::DOUBLE), '0+$', ''), '\\.$', '')"
PAY = f"""pay AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_type END AS color, (p_size - 10) || '–' || p_size || ' °C' AS temperature, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 2.0 END AS alcohol,
     CASE WHEN p_partkey % 2 = 0 THEN p_size / 2.0 + p_partkey % 4 END AS amax, 'item ' || p_name AS category FROM part),
   fm AS (SELECT slug, nullif(trim(color), '') AS shade, replace(replace(replace(temperature, '–', '-'), '°C', ''), '°', '') AS t0, {FMT.format(x='alcohol')} AS a, {FMT.format(x='amax')} AS b,
     CASE WHEN ends_with(category, 'red ring') THEN 'red ring' WHEN ends_with(category, 'ring') THEN 'ring' WHEN ends_with(category, 'bolt') THEN 'bolt' END AS sugar FROM pay),
   f2 AS (SELECT slug, shade, sugar, trim(t0) || '°C' AS tt, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN a || '-' || b || '%' ELSE coalesce(a, b) || '%' END AS aa FROM fm),
   f3 AS (SELECT *, aa IS NOT NULL AND len(list_filter(list_transform(regexp_extract_all(aa, '\\d+(?:[.,]\\d+)?'), lambda x: x::DOUBLE), lambda x: x NOT BETWEEN 3 AND 25)) > 0 AS odd_a,
      len(list_filter(list_transform(regexp_extract_all(tt, '\\d+(?:[.,]\\d+)?'), lambda x: x::DOUBLE), lambda x: x NOT BETWEEN 0 AND 25)) > 0 AS odd_t FROM f2),
   val AS (SELECT slug, shade, sugar, CASE WHEN NOT odd_t THEN tt END AS serving_temperature, CASE WHEN NOT odd_a THEN aa END AS alcohol, concat_ws('; ', CASE WHEN odd_a THEN 'alcohol=' || aa END, CASE WHEN odd_t THEN 'serving_temperature=' || tt END) AS suspicious FROM f3)"""


def payloads(spark, d):
    size = C("p_size")
    raw = Tables(spark, d).part.select(
        C("p_partkey").alias("slug"), F.when(C("p_partkey") % 5 == 0, " ").otherwise(C("p_type")).alias("color"), F.concat((size - 10).cast("string"), F.lit("–"), size.cast("string"), F.lit(" °C")).alias("temperature"),
        F.when(C("p_partkey") % 7 != 0, size / 2.0).alias("alcohol"), F.when(C("p_partkey") % 2 == 0, size / 2.0 + C("p_partkey") % 4).alias("alcohol_max"), F.concat(F.lit("Item "), "p_name").alias("category"),
    )
    return n.payload_values(raw, ("red ring", "ring", "bolt"))


@query("payload_values", "N3,N4,N5,N6,N7", f"WITH {PAY} SELECT * FROM val")
def _(spark, d):
    return payloads(spark, d).withColumn("suspicious", F.array_join("suspicious", "; "))


@query(
    "filled_missing_fields", "N3",
    f"""WITH {PAY}, it AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 2 = 0 THEN 'own' END AS shade, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '9°C' END AS serving_temperature, NULL::VARCHAR AS alcohol, CASE WHEN p_size > 20 THEN p_name END AS sugar FROM part),
        j AS (SELECT it.slug, coalesce(nullif(trim(it.shade), ''), val.shade) AS shade, coalesce(nullif(trim(it.serving_temperature), ''), val.serving_temperature) AS serving_temperature, val.alcohol, coalesce(it.sugar, val.sugar) AS sugar,
          concat_ws(',', CASE WHEN it.shade IS NULL AND val.shade IS NOT NULL THEN 'shade' END, CASE WHEN it.serving_temperature = '' AND val.serving_temperature IS NOT NULL THEN 'serving_temperature' END, CASE WHEN val.alcohol IS NOT NULL THEN 'alcohol' END, CASE WHEN it.sugar IS NULL AND val.sugar IS NOT NULL THEN 'sugar' END) AS filled FROM it LEFT JOIN val USING (slug))
        SELECT *, concat_ws(',', CASE WHEN shade IS NULL THEN 'shade' END, CASE WHEN serving_temperature IS NULL THEN 'serving_temperature' END, CASE WHEN alcohol IS NULL THEN 'alcohol' END, CASE WHEN sugar IS NULL THEN 'sugar' END) AS missing FROM j""",
)
def _(spark, d):
    items = Tables(spark, d).part.select(
        C("p_partkey").alias("slug"), F.when(C("p_partkey") % 2 == 0, "own").alias("shade"), F.when(C("p_partkey") % 3 == 0, "").otherwise("9°C").alias("serving_temperature"),
        F.lit(None).cast("string").alias("alcohol"), F.when(C("p_size") > 20, C("p_name")).alias("sugar"),
    )
    out = n.fill_missing(items, payloads(spark, d))
    return out.select("slug", *n.PAYLOAD_FIELDS, F.array_join("filled", ",").alias("filled"), F.array_join("missing", ",").alias("missing"))


@query("filled_missing_links", "N3", f"WITH o AS (SELECT DISTINCT l_partkey AS p_partkey, {q.uuid5(DIM.hex, 'lower(l_returnflag || chr(32) || l_linestatus)')} AS dim_id FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) SELECT {q.uuid5(LINK.hex, 'p_partkey || chr(58) || dim_id')} AS id, p_partkey, dim_id FROM o")
def _(spark, d):
    x = Tables(spark, d)
    links = x.lineitem.filter("l_quantity = 50").select(C("l_partkey").alias("p_partkey"))
    offered = x.lineitem.select(C("l_partkey").alias("p_partkey"), C("l_linenumber").alias("pos"), F.concat(F.lit(" "), "l_returnflag", F.lit("  "), "l_linestatus").alias("name"))
    return n.fill_missing_links(x.part.select("p_partkey"), links, offered, "p_partkey", DIM, LINK)


@query("first_spellings", "N13", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    return n.first_spelling(Tables(spark, d).documents.select("doc_id", "text"), "text", ["doc_id"])


# --- phrases: sentences of the benchmark table looked up in all documents -------------------------
def sentence_phrases(spark, d):
    b = Tables(spark, d).benchmark.select("item_id", F.posexplode(F.split("text", "[.,\\n]")).alias("pos", "spelling"))
    return b.select(F.concat_ws("-", C("item_id").cast("string"), C("pos").cast("string")).alias("entity"), "spelling")


PHRASE = f"""tk AS MATERIALIZED (SELECT doc_id, list_filter(string_split({q.match_text('text')}, ' '), lambda x: x <> '') AS w FROM documents),
   ps AS (SELECT DISTINCT phrase FROM (SELECT {q.match_text('s')} AS phrase FROM (SELECT unnest(regexp_split_to_array(text, '[.,\\n]')) AS s FROM benchmark)) WHERE phrase <> ''),
   pt AS MATERIALIZED (SELECT phrase, string_split(phrase, ' ') AS p FROM ps), ex AS MATERIALIZED (SELECT doc_id, w, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM tk)"""


@query("phrase_hits", "N9", f"WITH {PHRASE} SELECT doc_id, phrase, (pos - 1)::INTEGER AS start, (pos - 1 + len(p))::INTEGER AS end_pos FROM ex JOIN pt ON p[1] = tok WHERE w[pos:pos + len(p) - 1] = p")
def _(spark, d):
    words = F.filter(F.split(t.match_text(C("text")), " "), lambda x: x != "")
    texts = spread(Tables(spark, d).documents.select("doc_id", "text")).select("doc_id", words.alias("tokens"))
    ph = sentence_phrases(spark, d).select(t.match_text(C("spelling")).alias("phrase_id")).filter("phrase_id <> ''").distinct().withColumn("phrase", F.split("phrase_id", " "))
    return phrase_places(texts, ph, "doc_id").select("doc_id", C("phrase_id").alias("phrase"), "start", C("end").alias("end_pos"))


@query(
    "tagged_phrases", "N9",
    f"""WITH {PHRASE}, cut AS (SELECT item_id, regexp_split_to_array(text, '[.,\\n]') AS a FROM benchmark),
        nm AS (SELECT DISTINCT entity, {q.match_text('s')} AS phrase FROM (SELECT item_id || '-' || unnest(range(0, len(a))) AS entity, unnest(a) AS s FROM cut)),
        pn AS MATERIALIZED (SELECT entity, md5(entity || ':' || phrase) AS phrase_id, string_split(phrase, ' ') AS p, length(phrase) AS c FROM nm WHERE phrase NOT IN ('', 'er', 'th')),
        hit AS (SELECT doc_id, len(p) AS l, c, phrase_id, (pos - 1)::INTEGER AS a, [{{'entity': entity, 'phrase_id': phrase_id, 'a': (pos - 1)::INTEGER, 'z': (pos - 1 + len(p))::INTEGER}}] AS x
                FROM ex JOIN pn ON p[1] = tok WHERE w[pos:pos + len(p) - 1] = p),
        ls AS (SELECT doc_id, list(x ORDER BY l DESC, c DESC, phrase_id, a) AS s FROM hit GROUP BY doc_id),
        pk AS (SELECT doc_id, unnest(list_reduce(s, lambda g, x: CASE WHEN len(list_filter(g, lambda o: o.entity = x[1].entity OR (x[1].a < o.z AND o.a < x[1].z))) > 0 THEN g ELSE g || x END)) AS r FROM ls)
        SELECT doc_id, r.entity AS entity, r.phrase_id AS phrase_id, r.a AS start, r.z AS "end" FROM pk WHERE NOT (r.entity = '0-0' AND doc_id IN (SELECT doc_id FROM labels))""",
)
def _(spark, d):
    x = Tables(spark, d)
    known = x.labels.select("doc_id", F.lit("0-0").alias("entity"))
    return n.tag_phrases(x.documents, sentence_phrases(spark, d), "doc_id", "text", known, ["er", "th"])


# --- aliases: Cyrillic spellings of part names -----------------------------------------------------
def ru_lat_sql(expr: str) -> str:
    multi = [(k, w) for k, w in t.RU_TO_LAT.items() if len(w) > 1]
    single = {k: w for k, w in t.RU_TO_LAT.items() if len(w) == 1}
    gone = "".join(k for k, w in t.RU_TO_LAT.items() if not w)
    out = f"lower({expr})"
    for k, w in multi:
        out = f"replace({out}, '{k}', '{w}')"
    return f"translate({out}, '{''.join(single)}{gone}', '{''.join(single.values())}')"


@query(
    "derived_aliases", "N10",
    f"""WITH pr AS (SELECT p_partkey AS ord, string_split({q.ru_letters('p_name')}, ' ') AS a, string_split(replace(p_name, 'e', 'ee'), ' ') AS b FROM part), w AS (SELECT ord, unnest(a) AS word, unnest(b) AS spelling, unnest([0, 1]) AS pos FROM pr WHERE len(list_filter(a, lambda x: NOT regexp_full_match(x, '[а-яё]+'))) = 0),
        dict AS (SELECT word, arg_min(spelling, ord * 10 + pos) AS spelling FROM w WHERE length(word) > 2 AND {ru_lat_sql('word')} <> spelling GROUP BY word),
        nm AS (SELECT p_partkey, unnest(regexp_extract_all({q.ru_letters("p_name || ' ' || p_type")}, '[a-zа-яё]+')) AS word, unnest(range(0, 3)) AS pos FROM part),
        b AS (SELECT p_partkey, string_agg(coalesce(spelling, {ru_lat_sql('nm.word')}), ' ' ORDER BY pos) AS alias, count(spelling) AS known FROM nm LEFT JOIN dict ON dict.word = nm.word WHERE nm.word IS NOT NULL GROUP BY p_partkey)
        SELECT p_partkey, alias FROM b WHERE known > 0 AND p_partkey % 6 <> 0""",
)
def _(spark, d):
    p = Tables(spark, d).part
    pairs = p.select(C("p_partkey").alias("ord"), t.lat_to_ru(C("p_name")).alias("name"), F.replace("p_name", F.lit("e"), F.lit("ee")).alias("alias"))
    names = p.select("p_partkey", t.lat_to_ru(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    words = n.word_dictionary(pairs)
    every = n.derive_aliases(names, words, names.select("p_partkey", F.lit("").alias("alias")), "p_partkey")
    existing = every.filter("p_partkey % 6 = 0").select("p_partkey", F.upper("alias").alias("alias"))
    return n.derive_aliases(names, words, existing, "p_partkey").select("p_partkey", F.lower("alias").alias("alias"))


def brand_rows(spark, d):
    p = Tables(spark, d).part
    dims = p.select(v.uuid5(DIM, F.lower("p_brand")).alias("id"), C("p_brand").alias("name")).distinct()
    rows = p.select("p_partkey", v.uuid5(DIM, F.lower("p_brand")).alias("dim_id"))
    resolved = p.filter("p_size <> 9").select("p_partkey", F.when(C("p_size") % 2 == 0, F.concat(F.lit(" BRAND#"), C("p_size").cast("string"), F.lit(" "))).when(C("p_size") % 3 == 0, "old label").otherwise(F.concat(F.lit("New "), C("p_type"))).alias("resolved"))
    return n.replace_placeholder(rows, dims, resolved, "p_partkey", "dim_id", "Brand#1", {"old label": "Brand#2"}, DIM)


PLACE = f"""p0 AS (SELECT p_partkey, p_brand, CASE WHEN p_size = 9 THEN NULL WHEN p_size % 2 = 0 THEN 'BRAND#' || p_size WHEN p_size % 3 = 0 THEN 'Brand#2' ELSE 'New ' || p_type END AS r FROM part),
   p1 AS (SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' OR r IS NULL THEN lower(p_brand) ELSE lower(r) END AS k, p_brand = 'Brand#1' AND r IS NOT NULL AS moved, r FROM p0),
   p2 AS (SELECT p_partkey, CASE WHEN moved AND k = 'brand#1' THEN {q.uuid5(DIM.hex, "'brand#1'")} ELSE {q.uuid5(DIM.hex, 'k')} END AS dim_id FROM p1)"""


@query("repointed_rows", "N11", f"WITH {PLACE} SELECT * FROM p2")
def _(spark, d):
    return brand_rows(spark, d)[0]


@query("repointed_dimension", "N11", f"WITH {PLACE}, new AS (SELECT lower(r) AS k, arg_min(r, p_partkey) AS name FROM p1 WHERE moved AND lower(r) NOT IN (SELECT lower(p_brand) FROM part WHERE p_brand <> 'Brand#1') GROUP BY 1) SELECT DISTINCT {q.uuid5(DIM.hex, 'lower(p_brand)')} AS id, p_brand AS name FROM part WHERE p_brand <> 'Brand#1' OR (SELECT count(*) FROM p1 WHERE k = 'brand#1') > 0 UNION ALL SELECT {q.uuid5(DIM.hex, 'k')}, name FROM new")
def _(spark, d):
    return brand_rows(spark, d)[1]


HEAD, ENTRY = "<h1>([^<]*)</h1>", "<p>(?:<b>)?([^.<]+)\\.([^<]+)</p>"
CLEAN = "regexp_replace(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '\\.{{2,}}(\\s|$)', '.\\1', 'g'), '\\.{{2,}}$', '.')"
UNESC = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def clean_sql(x: str) -> str:
    return CLEAN.format(x=UNESC.format(x=x))


@query(
    "page_glossary", "N12,F11",
    f"""WITH e AS (SELECT page_id, regexp_extract_all(html, '{ENTRY}', 1) AS ts, regexp_extract_all(html, '{ENTRY}', 2) AS ds, trim(regexp_extract(html, '{HEAD}', 1)) AS head FROM pages),
        r AS (SELECT page_id, head, unnest(ts) AS t0, unnest(ds) AS d0, unnest(range(0, len(ts))) AS pos FROM e),
        c AS (SELECT page_id, pos, head, {clean_sql('t0')} AS term, {clean_sql("regexp_replace(d0, '^\\s*[-–—:]\\s*', '')")} AS definition FROM r),
        f AS (SELECT *, row_number() OVER (PARTITION BY replace(lower(term), 'ё', 'е') ORDER BY page_id, pos) AS k FROM c WHERE term <> '' AND definition <> '')
        SELECT {q.uuid5(DIM.hex, "replace(lower(term), 'ё', 'е')")} AS id, term, CASE WHEN coalesce(head, '') <> '' THEN head ELSE upper(substr(term, 1, 1)) END AS letter, definition FROM f WHERE k = 1""",
)
def _(spark, d):
    return n.extract_glossary(Tables(spark, d).pages, "page_id", "html", DIM, heading=HEAD, entry=ENTRY, section=None)


# --- glossary annotation ----------------------------------------------------------------------------
def single_terms(spark, d):
    w = Tables(spark, d).benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("term")).distinct()
    return w.select(C("term").alias("term_id"), "term")


def phrase_terms(spark, d):
    w = Tables(spark, d).benchmark.select(F.explode(t.word_windows(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), 1), 2)).alias("term")).distinct()
    return w.select(C("term").alias("term_id"), "term").unionByName(single_terms(spark, d))


@query("term_index", "G1,F5", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM benchmark) SELECT term AS term_id, {q.stem(q.ru_letters('term'))} AS stems, upper(substr(term, 1, 1)) AS letter FROM w")
def _(spark, d):
    terms = single_terms(spark, d).withColumn("shown", C("term")).withColumn("term", t.lat_to_ru(C("term")))
    # keep terms that are one word in the index's own word pattern
    return g.term_index(terms).join(single_terms(spark, d).withColumnRenamed("term", "shown"), "term_id").select("term_id", F.array_join("stems", " ").alias("stems"), F.upper(F.substring("shown", 1, 1)).alias("letter"))


@query(
    "glossary_word_hits", "G2",
    f"""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM benchmark),
        w AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '{t.WORD_PATTERN}')) AS word FROM documents),
        f AS (SELECT doc_id, word, unnest(['', {', '.join(f"'{e}'" for e in EN_ENDINGS)}]) AS ending FROM w)
        SELECT doc_id, term AS term_id, count(*) AS n FROM f JOIN terms ON ends_with(word, ending) AND term = substr(word, 1, length(word) - length(ending)) GROUP BY ALL""",
)
def _(spark, d):
    hits = g.term_hits(Tables(spark, d).documents, g.term_index(single_terms(spark, d)), "doc_id", "text", EN_ENDINGS)
    return hits.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "annotated_documents", "G2",
    f"""WITH b AS (SELECT regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM benchmark),
        tm AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM b UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) FROM benchmark),
        terms AS MATERIALIZED (SELECT term, split_part(term, ' ', 1) AS t1, nullif(split_part(term, ' ', 2), '') AS t2 FROM tm),
        f AS (SELECT doc_id, replace(lower(text), 'ё', 'е') AS x FROM documents),
        u AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word, unnest(list_slice(s, 1, len(w))) AS sep FROM (SELECT doc_id, regexp_extract_all(x, '{t.WORD_PATTERN}') AS w, regexp_split_to_array(x, '{t.WORD_PATTERN}') AS s FROM f)),
        wd AS MATERIALIZED (SELECT doc_id, i, word, sum(length(sep) + length(word)) OVER o AS z, lead(word) OVER o AS word2, lead(sep) OVER o AS sep2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        en AS (SELECT unnest(['', {', '.join(f"'{e}'" for e in EN_ENDINGS)}]) AS ending),
        c AS (SELECT wd.*, term, t2 FROM wd JOIN en ON ends_with(word, ending) JOIN terms ON t1 = substr(word, 1, length(word) - length(ending))),
        h AS (SELECT DISTINCT doc_id, i, term, CASE WHEN t2 IS NULL THEN 1 ELSE 2 END AS n, (z - length(word))::INTEGER AS a, (CASE WHEN t2 IS NULL THEN z ELSE z + length(sep2) + length(word2) END)::INTEGER AS e FROM c
              WHERE t2 IS NULL OR (starts_with(word2, t2) AND regexp_full_match(sep2, '\\s*') AND list_contains(['', {', '.join(f"'{e}'" for e in EN_ENDINGS)}], substr(word2, length(t2) + 1)))),
        ls AS (SELECT doc_id, list({{'next': i + n, 'got': [{{'i': i, 'term': term, 'a': a, 'e': e}}]}} ORDER BY i, n DESC, term) AS s FROM h GROUP BY doc_id),
        pk AS (SELECT doc_id, unnest(list_reduce(s, lambda g, x: CASE WHEN x.got[1].i < g.next OR len(list_filter(g.got, lambda o: o.term = x.got[1].term)) > 0 THEN g ELSE {{'next': x.next, 'got': g.got || x.got}} END).got) AS r FROM ls)
        SELECT doc_id, r.term AS term_id, r.a AS start, r.e AS "end" FROM pk""",
)
def _(spark, d):
    return g.annotate_terms(Tables(spark, d).documents, g.term_index(phrase_terms(spark, d)), "doc_id", "text", EN_ENDINGS)


@query("term_search", "G3,G4", "SELECT term_id, term FROM (SELECT DISTINCT p_name AS term_id, p_name AS term FROM part) WHERE contains(term, 're') ORDER BY NOT starts_with(term, 're'), term LIMIT 8")
def _(spark, d):
    terms = Tables(spark, d).part.select(C("p_name").alias("term_id"), C("p_name").alias("term")).distinct()
    return g.search_terms(terms, " RE ")


@query("term_details", "G4", "SELECT a.term_id, b.letter FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS term_id FROM part) a LEFT JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS term_id, upper(substr(p_name, 1, 1)) AS letter FROM part WHERE p_name > 'c') b USING (term_id)")
def _(spark, d):
    p = Tables(spark, d).part
    terms = p.filter("p_name > 'c'").select(F.split("p_name", " ")[0].alias("term_id"), F.upper(F.substring("p_name", 1, 1)).alias("letter")).distinct()
    return g.term_detail(terms, p.select(F.split("p_name", " ")[0].alias("term_id")).distinct()).select("term_id", "letter")
