"""File formats: tables written and read back through the catalogue's own formats, inventories, evaluation files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.operators import evaluation
from catalens.plans.registry import Tables, query
from catalens.session import scratch_path
from catalens.sources import files as s

C = F.col


@query("catalog_round_trip", "S1", "SELECT 'food' AS tbl, p_partkey::VARCHAR AS id, p_name AS name FROM part UNION ALL SELECT 'producers', p_brand, p_brand FROM part GROUP BY p_brand")
def _(spark, d):
    p = Tables(spark, d).part
    base = scratch_path(spark, "catalog")
    p.select(C("p_partkey").cast("string").alias("id"), C("p_name").alias("name")).write.json(f"{base}/food.json")
    p.select(C("p_brand").alias("id"), C("p_brand").alias("name")).distinct().write.json(f"{base}/producers.json")
    schemas = {k: s.CATALOG_SCHEMAS[k] for k in ("food", "producers", "wine_terms")}
    t = s.read_catalog(spark, base, schemas, arrays=False)
    terms = t["wine_terms"].select(F.lit("terms").alias("tbl"), "id", C("term").alias("name"))
    return t["food"].select(F.lit("food").alias("tbl"), "id", "name").unionByName(t["producers"].select(F.lit("producers").alias("tbl"), "id", "name")).unionByName(terms)


INVENTORY = """inv AS (SELECT l_partkey::VARCHAR AS item, CASE l_suppkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'yandex_' || l_linenumber WHEN 2 THEN 'flux_' || l_linenumber WHEN 3 THEN 'vivino_' || l_linenumber ELSE 'other_' || l_linenumber END AS photo, l_returnflag <> 'R' AS ok FROM lineitem)"""


def photo_paths(spark, d):
    k, n = C("l_suppkey") % 5, C("l_linenumber").cast("string")
    photo = F.when(k == 0, "main").when(k == 1, F.concat(F.lit("yandex_"), n)).when(k == 2, F.concat(F.lit("flux_"), n)).when(k == 3, F.concat(F.lit("vivino_"), n)).otherwise(F.concat(F.lit("other_"), n))
    ext = F.when(C("l_returnflag") != "R", "jpg").otherwise("png")
    return Tables(spark, d).lineitem.select(F.concat(F.lit("file:/data/images/"), C("l_partkey").cast("string"), F.lit("/"), photo, F.lit("/original."), ext).alias("path"))


@query("photo_inventory", "S6", f"WITH {INVENTORY} SELECT item, photo, item || '/' || photo || '/original.jpg' AS object_name, photo = 'main' AS is_main, starts_with(photo, 'flux') AS is_generated, split_part(photo, '_', 1) AS kind, NOT bool_or(ok) AS missing FROM inv WHERE NOT starts_with(photo, 'other') GROUP BY item, photo")
def _(spark, d):
    return s.photo_inventory(photo_paths(spark, d))


@query("eval_photo_set", "E8", f"WITH {INVENTORY} SELECT item AS expected, photo, count(*) AS n FROM inv GROUP BY ALL")
def _(spark, d):
    return s.eval_paths(photo_paths(spark, d), "images").groupBy("expected", "photo").agg(F.count(F.lit(1)).alias("n"))


@query("embedding_checks", "S7", "SELECT count(*) AS vectors, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim, count_if(vec_id IS NULL)::BIGINT AS missing_ids, 0::BIGINT AS broken, 0::BIGINT AS repeated_ids, true AS ok FROM embeddings")
def _(spark, d):
    return s.check_embeddings(Tables(spark, d).embeddings, "vec_id", "embedding")


@query("stored_embeddings", "S8", "SELECT 'v2' AS version, vec_id % 3 = 0 AS main_view, count(*) AS n, 'wine_' || CASE WHEN vec_id % 3 = 0 THEN 'original' ELSE 'crop' END || '_enc_v2' AS collection FROM embeddings GROUP BY ALL")
def _(spark, d):
    e = Tables(spark, d).embeddings.withColumn("view", F.when(C("vec_id") % 3 == 0, "original").otherwise("crop"))
    path = scratch_path(spark, "vectors")
    s.write_embeddings(e, path, "v1")
    s.write_embeddings(e, path, "v2")
    s.write_embeddings(e, path, "v2")  # nothing left to write
    s.drop_stale(spark, path, "v2")
    rows = spark.read.parquet(path)
    named = rows.select("version", (C("view") == "original").alias("main_view"), s.collection_name(C("view"), "enc", "v2").alias("collection"))
    return named.groupBy("version", "main_view", "collection").agg(F.count(F.lit(1)).alias("n"))


MANIFEST = "mf AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'q ' || o_orderkey WHEN o_orderkey % 8 = 0 THEN 'q-8' ELSE 'q-' || o_orderkey END AS query_id, CASE o_orderkey % 7 WHEN 1 THEN '/abs.jpg' WHEN 2 THEN 'a/../b.jpg' ELSE 'img/' || o_orderkey || '.jpg' END AS image_path FROM orders)"


def manifest(spark, d):
    k = C("o_orderkey")
    qid = F.when(k % 9 == 0, F.concat(F.lit("q "), k.cast("string"))).when(k % 8 == 0, "q-8").otherwise(F.concat(F.lit("q-"), k.cast("string")))
    path = F.when(k % 7 == 1, "/abs.jpg").when(k % 7 == 2, "a/../b.jpg").otherwise(F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg")))
    return Tables(spark, d).orders.select(qid.alias("query_id"), path.alias("image_path"))


@query("checked_manifest", "S9", f"WITH {MANIFEST} SELECT query_id, image_path, concat_ws('; ', CASE WHEN NOT regexp_full_match(query_id, '[A-Za-z0-9._-]+') THEN 'bad id' END, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN 'repeated id' END, CASE WHEN starts_with(image_path, '/') THEN 'absolute path' END, CASE WHEN contains(image_path, '..') THEN 'climbing path' END) AS problems FROM mf")
def _(spark, d):
    base = scratch_path(spark, "manifest")
    manifest(spark, d).write.option("sep", "\t").option("header", True).csv(f"{base}/queries.tsv")
    rows = s.check_manifest(s.read_tsv(spark, f"{base}/queries.tsv", s.MANIFEST_SCHEMA))
    return rows.withColumn("problems", F.array_join("problems", "; "))


@query(
    "document_checksums", "S10",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'changed' ELSE 'ok' END AS sha_state, md5(text) AS md5_digest, sha256(text) AS sha_digest FROM documents""",
)
def _(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    listed = docs.select("doc_id", F.when(C("doc_id") % 10 == 4, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("digest"))
    state = s.verify_checksums(docs.filter("doc_id % 10 <> 3"), listed, "doc_id", "text")
    return docs.join(state, "doc_id").select("doc_id", C("state").alias("sha_state"), F.md5("text").alias("md5_digest"), F.sha2("text", 256).alias("sha_digest"))


@query("site_payloads", "S11", "SELECT p_partkey::VARCHAR AS slug, p_partkey % 6 <> 0 AS found, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS color, CASE WHEN p_partkey % 6 <> 0 THEN p_size::VARCHAR END AS alcohol, CASE WHEN p_partkey % 6 <> 0 THEN replace(p_name, ' ', '|') END AS dishes, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS producer FROM part")
def _(spark, d):
    dishes = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("name")))
    payload = F.struct(C("p_type").alias("color"), C("p_size").cast("string").alias("alcohol"), dishes.alias("dishes"), F.struct(C("p_brand").alias("name")).alias("manufacturer"))
    base = scratch_path(spark, "payloads")
    rows = Tables(spark, d).part.select(C("p_partkey").cast("string").alias("slug"), F.when(C("p_partkey") % 6 != 0, payload).alias("payload"))
    rows.write.option("ignoreNullFields", False).json(base)
    raw = spark.read.schema(s.PAYLOAD_SCHEMA).json(base)
    return s.site_payloads(raw).select("slug", "found", "color", "alcohol", F.array_join("dishes", "|").alias("dishes"), "producer")


TRUTH = "tr AS (SELECT o_orderkey, 'q-' || o_orderkey AS query_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'item-' || (o_custkey % 50) END AS expected_slug FROM orders), pr AS (SELECT 'q-' || o_orderkey AS query_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'item-0' ELSE 'item-' || (o_custkey % 50) END AS predicted_slug, round(o_totalprice / 100)::BIGINT AS latency_ms FROM orders WHERE o_orderkey % 11 <> 0)"


def predictions(spark, d):
    o = Tables(spark, d).orders.filter("o_orderkey % 11 <> 0")
    k = C("o_orderkey")
    slug = F.when(k % 5 == 0, "").when(k % 6 == 0, "item-0").otherwise(F.concat(F.lit("item-"), (C("o_custkey") % 50).cast("string")))
    rows = o.select(F.concat(F.lit("q-"), k.cast("string")).alias("query_id"), F.lit("x.jpg").alias("image_path"), F.sha2(k.cast("string"), 256).alias("image_sha256"), slug.alias("predicted_slug"), (C("o_totalprice") / 100).alias("latency_ms"))
    path = scratch_path(spark, "predictions")
    s.write_predictions(rows, path)
    return spark.read.schema(s.PREDICTION_SCHEMA).json(path)


@query("written_predictions", "S13", f"WITH {TRUTH} SELECT * FROM pr")
def _(spark, d):
    return predictions(spark, d).select("query_id", "predicted_slug", "latency_ms")


@query("predictions_with_truth", "E7", f"WITH {TRUTH} SELECT query_id, expected_slug, predicted_slug, latency_ms, expected_slug IS NOT NULL AS present, coalesce(expected_slug = predicted_slug, false) AS correct FROM tr LEFT JOIN pr USING (query_id)")
def _(spark, d):
    k = C("o_orderkey")
    truth = Tables(spark, d).orders.select(F.concat(F.lit("q-"), k.cast("string")).alias("query_id"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("item-"), (C("o_custkey") % 50).cast("string"))).alias("expected_slug"))
    return evaluation.join_truth(predictions(spark, d), truth).select("query_id", "expected_slug", "predicted_slug", "latency_ms", "present", "correct")


@query("normalised_responses", "E9,S14", "SELECT l_orderkey AS query, rank, item, score FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS rank, l_partkey::VARCHAR AS item, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_discount END AS score FROM lineitem)")
def _(spark, d):
    k = C("l_linenumber")
    hit = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(k % 2 == 0, C("l_partkey").cast("string")).alias("id"), F.when(k % 2 == 1, C("l_partkey").cast("string")).alias("wine_id"),
                   F.when(k % 3 == 1, C("l_discount")).alias("score"), F.when(k % 3 == 2, C("l_discount")).alias("similarity"))
    per = Tables(spark, d).lineitem.groupBy(C("l_orderkey").alias("query")).agg(F.array_sort(F.collect_list(hit)).alias("h"))  # one response: the items of one order
    body = F.to_json(F.struct(F.transform("h", lambda x: x.dropFields("l_linenumber", "l_partkey", "l_suppkey")).alias("results")))
    path = scratch_path(spark, "responses")
    s.write_eval_report(per.select("query", body.alias("body")), path)
    return s.normalise_response(spark.read.schema("query long, body string").json(path), "query", "body")
