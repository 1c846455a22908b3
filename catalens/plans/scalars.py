"""Scalar functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalens.functions import similarity, text, values, vectors
from catalens.plans import sqltext as q
from catalens.plans.registry import Tables, query
from catalens.session import materialize

ITEM_NS = uuid.uuid5(uuid.NAMESPACE_URL, "catalens/item")


@query("normalize_label_text", "F1", f"SELECT doc_id, {q.match_text('text')} AS norm FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", text.normalize_match_text(F.col("text")).alias("norm"))


@query("normalize_label_text_nfkc", "F1 with NFKC", f"SELECT page_id, {q.match_text('nfc_normalize(html)')} AS norm FROM pages")
def _(spark, d):
    return Tables(spark, d).pages.select("page_id", text.match_text(F.col("html")).alias("norm"))


@query(
    "spelling_variants", "F2",
    f"""SELECT turn_key, count(*) AS variants, sum(length(v))::BIGINT AS letters, string_agg(v, '|' ORDER BY i) AS joined FROM (
        SELECT turn_key, v, min(i) AS i FROM (
          SELECT conv_id || '-' || turn AS turn_key, unnest([{q.match_text('text')}, {q.match_text('lower(text)')}, {q.match_text(q.ru_letters('text'))}]) AS v,
                 unnest([1, 2, 3]) AS i FROM conversations)
        WHERE v <> '' GROUP BY turn_key, v) GROUP BY turn_key""",
)
def _(spark, d):
    df = Tables(spark, d).conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_key"), text.text_variants(F.col("text")).alias("v")
    )
    return df.filter(F.size("v") > 0).select(
        "turn_key", F.size("v").cast("long").alias("variants"),
        F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("letters"),
        F.array_join("v", "|").alias("joined"),
    )


@query("normalize_search_text", "F3", f"SELECT conv_id, turn, {q.query_text('text')} AS norm FROM conversations")
def _(spark, d):
    return Tables(spark, d).conversations.select("conv_id", "turn", text.normalize_query(F.col("text")).alias("norm"))


@query("search_latin", "F4", f"SELECT doc_id, {q.search_latin(q.query_text('text'))} AS latin FROM documents")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", text.to_search_latin(text.normalize_query(F.col("text"))).alias("latin"))


@query(
    "cyrillic_stems", "F2,F5",
    f"""SELECT stem, count(*) AS n FROM (SELECT {q.stem('w')} AS stem FROM (
        SELECT unnest({q.words(q.ru_letters("regexp_replace(text, '[^A-Za-z]+', ' ', 'g')"))}) AS w FROM documents)) GROUP BY stem""",
)
def _(spark, d):
    letters = F.regexp_replace("text", "[^A-Za-z]+", " ")
    w = Tables(spark, d).documents.select(F.explode(text.tokens(text.lat_to_ru(letters))).alias("w"))
    return w.groupBy(text.stem(F.col("w")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_windows", "F6",
    """WITH t AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM benchmark)
       SELECT item_id, win, count(*) AS n FROM (
         SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS win FROM t
         UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || w[i+1])) AS win FROM t)
       GROUP BY item_id, win""",
)
def _(spark, d):
    t = Tables(spark, d).benchmark.select("item_id", F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("w"))
    wins = F.concat(text.word_windows(F.col("w"), 3), text.bigram_glue(F.col("w")))
    return t.select("item_id", F.explode(wins).alias("win")).groupBy("item_id", "win").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alcohol_values", "F7",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ',5-' || (p_size + 1) || '%' WHEN p_partkey % 3 = 1 THEN p_size || '%' ELSE p_size || '.5' END AS txt FROM part)
       SELECT p_partkey, list_sum(a) AS label_sum, len(a)::BIGINT AS label_n,
              CASE WHEN len(c) > 0 THEN list_sum(c) / len(c) END AS catalog_avg
       FROM (SELECT p_partkey,
              CASE WHEN txt LIKE '%\\%%' ESCAPE '\\' THEN list_filter(list_transform(regexp_extract_all(txt, '\\d{1,2}(?:[.,]\\d{1,2})?'), lambda x: replace(x, ',', '.')::DOUBLE), lambda x: x BETWEEN 5 AND 25) ELSE []::DOUBLE[] END AS a,
              list_filter(list_transform(regexp_extract_all(txt, '\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')::DOUBLE), lambda x: x BETWEEN 3 AND 25) AS c FROM s)""",
)
def _(spark, d):
    size = F.col("p_size").cast("string")
    txt = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(",5-"), (F.col("p_size") + 1).cast("string"), F.lit("%")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("%")))
        .otherwise(F.concat(size, F.lit(".5")))
    )
    a = values.alcohol_numbers(txt)
    return Tables(spark, d).part.select(
        "p_partkey",
        F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y)).alias("label_sum"),
        F.size(a).cast("long").alias("label_n"),
        values.parse_alcohol_avg(txt).alias("catalog_avg"),
    )


LCS_SQL = """list_reduce(list_concat([list_transform(range(0, length({b}) + 1), lambda x: 0)], list_transform(string_split({a}, ''), lambda c: [unicode(c)])),
   lambda acc, ch: list_transform(range(1, length({b}) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN 0 WHEN unicode(substr({b}, (k - 1)::BIGINT, 1)) = ch[1] THEN greatest(acc[k], acc[k-1] + 1) ELSE acc[k] END))))[length({b}) + 1]"""


@query(
    "name_indel_ratio", "F8",
    f"""WITH w AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a AS a, y.a AS b FROM w x JOIN w y ON x.a < y.a)
        SELECT a, b, round(2.0 * {LCS_SQL.format(a='a', b='b')} / (length(a) + length(b)), 6) AS ratio FROM p""",
)
def _(spark, d):
    """Every pair of different names."""
    names = materialize(Tables(spark, d).part.select(F.col("p_name").alias("a")).distinct(), "names")
    pairs = names.hint("shuffle_replicate_nl").join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(
    "similar_name_words", "F8,J8",
    f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS known FROM part),
             n AS (SELECT DISTINCT unnest([known, replace(known, 'e', ''), replace(known, 'i', 'l'), known || 's', substr(known, 2)]) AS word FROM w)
        SELECT word, known, round(ratio, 6) AS ratio FROM (
          SELECT word, known, 2.0 * {LCS_SQL.format(a='word', b='known')} / (length(word) + length(known)) AS ratio FROM n, w) WHERE ratio >= 0.75""",
)
def _(spark, d):
    known = Tables(spark, d).part.select(F.explode(F.split("p_name", " ")).alias("known")).distinct()
    k = F.col("known")
    noisy = known.select(F.explode(F.array(
        k, F.replace(k, F.lit("e"), F.lit("")), F.replace(k, F.lit("i"), F.lit("l")), F.concat(k, F.lit("s")), F.substr(k, F.lit(2))
    )).alias("word")).distinct()
    return similarity.similar_pairs(noisy, known, 0.75).withColumn("ratio", F.round("ratio", 6))


@query("item_uuids", "F11", f"SELECT p_partkey, {q.uuid5(ITEM_NS.hex, 'p_name || chr(58) || p_partkey')} AS item_uuid FROM part")
def _(spark, d):
    return Tables(spark, d).part.select(
        "p_partkey", values.uuid5(ITEM_NS, F.concat_ws(":", "p_name", F.col("p_partkey").cast("string"))).alias("item_uuid")
    )


@query(
    "idf_tables", "F13,A9",
    """WITH tok AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS token FROM documents),
            n AS (SELECT count(*) AS n FROM documents), f AS (SELECT token, count(*) AS df FROM tok GROUP BY token)
       SELECT token, df, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS smooth, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS pool FROM f, n""",
)
def _(spark, d):
    from catalens.operators.aggregates import document_frequency

    docs = Tables(spark, d).documents.select("doc_id", F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("toks"))
    return document_frequency(docs, "toks", "token").select(
        "token", "df", F.round(values.idf_smooth(F.col("n"), F.col("df")), 6).alias("smooth"),
        F.round(values.idf_pool(F.col("n"), F.col("df")), 6).alias("pool"),
    )


@query(
    "clipped_bonus", "F14,F22",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         round(CASE WHEN s < 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (s - 0.55) / 0.45)) END, 6) AS bonus,
         CASE WHEN k > 100 THEN 'diamond' WHEN k >= 50 THEN 'gold' WHEN k >= 10 THEN 'silver' WHEN k >= 1 THEN 'bronze' ELSE 'none' END AS frame
       FROM (SELECT *, l_quantity / 40 - 0.1 AS s, l_suppkey + l_linenumber - 1 AS k FROM lineitem)""",
)
def _(spark, d):
    return Tables(spark, d).lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.round(values.clip_bonus(F.col("l_quantity") / 40 - 0.1), 6).alias("bonus"),
        values.review_frame(F.col("l_suppkey") + F.col("l_linenumber") - 1).alias("frame"),
    )


ZONES = ("Europe/Moscow", "America/New_York", "Asia/Tokyo", "Europe/London")


@query(
    "local_times", "F15,F16",
    f"""WITH z AS (SELECT *, CASE user_id % 5 WHEN 1 THEN '{ZONES[1]}' WHEN 2 THEN '{ZONES[2]}' WHEN 3 THEN '{ZONES[3]}' WHEN 4 THEN '{ZONES[0]}' ELSE '{ZONES[0]}' END AS zone FROM events),
             l AS (SELECT event_id, timezone(zone, timezone('UTC', ts)) AS local_ts FROM z)
        SELECT event_id, local_ts, hour(local_ts)::INTEGER AS h, dayofweek(local_ts) IN (0, 6) AS weekend, month(local_ts)::INTEGER AS m, local_ts::DATE AS day FROM l""",
)
def _(spark, d):
    zone = F.when(F.col("user_id") % 5 == 1, ZONES[1]).when(F.col("user_id") % 5 == 2, ZONES[2]).when(F.col("user_id") % 5 == 3, ZONES[3]).when(F.col("user_id") % 5 == 4, "Nowhere/Unknown")
    ts = F.col("local_ts")
    return (
        Tables(spark, d).events.withColumn("local_ts", values.local_time(F.col("ts").cast("timestamp"), zone).cast("timestamp_ntz"))
        .select("event_id", "local_ts", F.hour(ts).alias("h"), (F.weekday(ts) >= 5).alias("weekend"), F.month(ts).alias("m"), F.to_date(ts).alias("day"))
    )


@query("actor_pseudonyms", "F17,L6", "SELECT user_id, 'anon:' || substr(sha256(user_id::VARCHAR), 1, 10) AS actor, count(*) AS n FROM events GROUP BY user_id")
def _(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("actor", values.pseudonymise(F.col("user_id")))


@query(
    "nickname_rules", "F18,H15",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '_' || c_name WHEN c_custkey % 7 = 1 THEN replace(c_name, '#', '  ') ELSE replace(lower(c_name), '#', ' ') END AS nick, c_mktsegment FROM customer)
       SELECT c_custkey, lower(trim('  ' || nick || '@Mail.ORG ')) AS email,
              regexp_matches(nick, '^[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9_.\\- ]{1,22}[A-Za-zА-Яа-яЁё0-9_]$') AND NOT contains(nick, '  ') AS valid,
              count(*) OVER (PARTITION BY lower(c_mktsegment)) > 1 AS segment_taken FROM n""",
)
def _(spark, d):
    from catalens.operators.activity import taken_names

    c = F.col
    nick = (
        F.when(c("c_custkey") % 7 == 0, F.concat(F.lit("_"), c("c_name")))
        .when(c("c_custkey") % 7 == 1, F.replace(c("c_name"), F.lit("#"), F.lit("  ")))
        .otherwise(F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")))
    )
    people = Tables(spark, d).customer.withColumn("nick", nick)
    return taken_names(people, "c_custkey", "c_mktsegment", "segment_taken").select(
        "c_custkey", values.normalize_email(F.concat(F.lit("  "), c("nick"), F.lit("@Mail.ORG "))).alias("email"),
        values.valid_nickname(c("nick")).alias("valid"), "segment_taken",
    )


@query("answers_without_reasoning", "F23",
       """SELECT conv_id, turn, trim(regexp_replace(CASE WHEN role = 'assistant' THEN ' <think>' || substr(text, 1, 40) || E'\\n</think> ' || text ELSE text END, '(?s)^\\s*<think>.*?</think>', ''), E' ') AS answer FROM conversations""")
def _(spark, d):
    raw = F.when(F.col("role") == "assistant", F.concat(F.lit(" <think>"), F.substring("text", 1, 40), F.lit("\n</think> "), F.col("text"))).otherwise(F.col("text"))
    return Tables(spark, d).conversations.select("conv_id", "turn", text.strip_think(raw).alias("answer"))


@query(
    "unit_vectors", "F24,S7",
    """SELECT vec_id, pos, round(x / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS x FROM (
         SELECT vec_id, v, unnest(v) AS x, unnest(range(0, len(v)))::INTEGER AS pos FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * 3) AS v FROM embeddings))""",
)
def _(spark, d):
    scaled = F.transform(F.col("embedding"), lambda e: e.cast("double") * 3)
    return Tables(spark, d).embeddings.select("vec_id", F.posexplode(vectors.l2_normalize(scaled)).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "url_parameters", "F25,N8",
    """WITH u AS (SELECT page_id, url, split_part(split_part(url, '#', 1), '?', 2) AS qs, trim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS path FROM pages)
       SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split(qs, '&'), lambda p: split_part(p, '=', 1)), lambda k: k <> ''), ','), '') AS keys,
              CASE WHEN len(string_split(path, '/')) = 2 AND split_part(path, '/', 1) = 'en' AND split_part(path, '/', 2) <> '' THEN split_part(path, '/', 2) END AS slug FROM u""",
)
def _(spark, d):
    return Tables(spark, d).pages.select(
        "page_id", F.array_join(values.query_keys(F.parse_url("url", F.lit("QUERY"))), ",").alias("keys"),
        values.slug_from_url(F.col("url"), "en").alias("slug"),
    )


@query(
    "photo_paths", "F27,F28",
    """SELECT vec_id, CASE WHEN vec_id % 5 = 4 THEN NULL ELSE label || '/' || kind || '_' || vec_id END AS folder, kind FROM (
         SELECT vec_id, label, CASE vec_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'yandex' WHEN 2 THEN 'flux' ELSE 'vivino' END AS kind FROM embeddings)""",
)
def _(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("main", "yandex", "flux", "vivino")]), (F.col("vec_id") % 4 + 1).cast("int"))
    photo = F.concat_ws("_", kind, F.col("vec_id").cast("string"))
    folder = F.concat_ws("/", F.col("label").cast("string"), photo)
    line = (
        F.when(F.col("vec_id") % 5 == 4, F.concat(F.lit("Processed photos "), folder))
        .when(F.col("vec_id") % 5 == 3, F.concat(F.lit("2026-01-01 10:00:00 INFO __main__:  "), folder))
        .when(F.col("vec_id") % 5 == 2, F.concat(folder, F.lit("/original.jpg")))
        .otherwise(F.concat(F.lit(" /"), folder, F.lit("/")))
    )
    return Tables(spark, d).embeddings.select("vec_id", values.normalize_photo_dir(line).alias("folder"), values.source_kind(photo).alias("kind"))
