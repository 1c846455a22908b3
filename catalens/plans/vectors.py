"""Vector retrieval over the embeddings table: view = vec_id % 3, photo = vec_id, item = eight photos in turn."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from catalens.operators import evaluation as ev
from catalens.operators import retrieval as r
from catalens.operators.evidence import similarity
from catalens.plans.registry import Tables, query
from catalens.session import materialize

VIEWS = ("original", "bottle_crop", "label_crop")
K = 150


def photos(spark, d):
    e = Tables(spark, d).embeddings
    view = F.element_at(F.array(*[F.lit(v) for v in VIEWS]), (F.col("vec_id") % 3 + 1).cast("int"))
    kind = F.when(F.col("vec_id") % 4 == 0, "main").when(F.col("vec_id") % 4 == 1, "yandex").when(F.col("vec_id") % 4 == 2, "flux").otherwise("vivino")
    photo = F.when(F.col("vec_id") % 4 == 0, F.lit("main")).otherwise(F.concat_ws("_", kind, F.col("vec_id").cast("string")))
    return e.select(F.col("vec_id").alias("id"), view.alias("view"), F.floor(F.col("vec_id") / 8).cast("long").alias("item"), photo.alias("photo_id"), "embedding")


def items(spark, d):
    return photos(spark, d).select("id", "item")


E_SQL = """e AS (SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'bottle_crop' ELSE 'label_crop' END AS view, (vec_id // 8)::BIGINT AS item,
  CASE vec_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'yandex_' || vec_id WHEN 2 THEN 'flux_' || vec_id ELSE 'vivino_' || vec_id END AS photo_id,
  list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""


def match_sql(k: int, corpus: str = "true", queries: str = "true") -> str:
    """Every vector asks the corpus across all views' own collections: (query, view) against vectors of that view."""
    return f"""{E_SQL}, s AS (SELECT q.id AS query, c.view, c.id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
      FROM e q JOIN e c ON q.id <> c.id WHERE ({queries}) AND ({corpus})),
    m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, view ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k})"""


FOLD_SQL = """,
    cnt AS (SELECT query, view, count(*) AS points, CASE view WHEN 'original' THEN 0.30 WHEN 'bottle_crop' THEN 0.15 ELSE 0.55 END::DOUBLE AS w FROM m GROUP BY query, view),
    wt AS (SELECT *, w / sum(w) OVER (PARTITION BY query) AS weight FROM cnt),
    pv AS (SELECT m.query, e.item, m.view, max(score) AS best, count(*) AS photos, arg_max(m.id, score) AS photo, list_avg(list_slice(list_reverse_sort(list(score)), 1, 3)) AS top_mean
           FROM m JOIN e ON e.id = m.id GROUP BY m.query, e.item, m.view),
    sc AS (SELECT pv.*, weight * (0.75 * best + 0.25 * top_mean) AS part FROM pv JOIN wt USING (query, view)),
    it AS (SELECT query, item, 0.7 * max(part) + 0.3 * sum(part) AS score, max(part) AS max_score, avg(part) AS mean_score, count(*) AS n_views,
             stddev_pop(part) AS score_std, max(best) AS cosine, max(CASE WHEN view = 'label_crop' THEN photo END) AS label_photo,
             sum(photos)::BIGINT AS photos FROM sc GROUP BY query, item),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM it)"""


def all_view_queries(spark, d):
    """Every photo asks all three view collections, as a query photo with three crops does."""
    return photos(spark, d).drop("view").withColumn("view", F.explode(F.array(*[F.lit(v) for v in VIEWS])))


def self_matches(spark, d, k: int = K):
    return r.knn_join(all_view_queries(spark, d), photos(spark, d), k, exclude_self=True)


def self_lists(spark, d):
    return r.knn_lists(all_view_queries(spark, d), photos(spark, d), K, exclude_self=True)


def self_ranking(spark, d):
    return r.fold_lists(self_lists(spark, d))


@query("vector_neighbours", "V3,J9,T3", f"WITH {match_sql(K)} SELECT query, view, id, round(score, 6) AS score, rank FROM m")
def _(spark, d):
    return self_matches(spark, d).withColumn("score", F.round("score", 6))


@query("vector_neighbours_150", "V3", f"WITH {match_sql(150)} SELECT query, view, count(*) AS n, round(min(score), 6) AS kth, round(avg(score), 6) AS mean FROM m GROUP BY query, view")
def _(spark, d):
    m = self_matches(spark, d, 150)
    return m.groupBy("query", "view").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("kth"), F.round(F.avg("score"), 6).alias("mean"))


@query("vector_neighbours_cells", "V3 partitioned path", f"WITH {match_sql(K)} SELECT query, view, id, round(score, 6) AS score, rank FROM m")
def _(spark, d):
    return r.knn_cells(all_view_queries(spark, d), photos(spark, d), K, exclude_self=True).withColumn("score", F.round("score", 6))


@query("vector_neighbours_main_only", "P5,V3", f"WITH {match_sql(5, corpus=chr(99) + '.photo_id = ' + chr(39) + 'main' + chr(39))} SELECT query, view, id, round(score, 6) AS score, rank FROM m")
def _(spark, d):
    corpus = photos(spark, d).filter(F.col("photo_id") == "main")
    return r.knn_join(all_view_queries(spark, d), corpus, 5, exclude_self=True).withColumn("score", F.round("score", 6))


@query(
    "vector_self_retrieval", "V3,V4,V5,W4,A6,A7 (flagship)",
    f"""WITH {match_sql(K)}{FOLD_SQL} SELECT query, item, rank, round(score, 6) AS score, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score,
        n_views, round(score_std, 6) AS score_std, round(cosine, 6) AS cosine, label_photo, photos FROM ranked WHERE rank <= 50""",
)
def _(spark, d):
    total = F.aggregate(F.map_values("view_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    return self_ranking(spark, d).select(
        "query", "item", "rank", *[F.round(c, 6).alias(c) for c in ("score", "max_score", "mean_score", "score_std", "cosine")],
        "n_views", F.element_at("view_photos", "label_crop").alias("label_photo"), total.alias("photos"),
    )


@query("view_weights", "V4", f"WITH {match_sql(K)}{FOLD_SQL} SELECT query, view, points, round(weight, 6) AS weight FROM wt")
def _(spark, d):
    return r.view_weights(self_matches(spark, d)).withColumn("weight", F.round("weight", 6))


@query("nearest_item", "V6", f"WITH {match_sql(1)} SELECT m.query, m.view, m.id, e.item, round(score, 6) AS score FROM m JOIN e ON e.id = m.id")
def _(spark, d):
    return r.nearest_item(all_view_queries(spark, d), photos(spark, d), items(spark, d), exclude_self=True).withColumn("score", F.round("score", 6))


@query(
    "near_duplicate_photos", "V7,J10",
    f"""WITH {E_SQL}, n AS (SELECT id, view, item, v, sqrt(list_dot_product(v, v)) AS len FROM e)
        SELECT id, view, item, EXISTS (SELECT 1 FROM n b WHERE b.view = a.view AND b.item <> a.item AND list_dot_product(a.v, b.v) / (a.len * b.len) > 0.35) AS duplicate FROM n a""",
)
def _(spark, d):
    return r.near_duplicates(photos(spark, d), 0.35)


CENTROID_SQL = f"""{E_SQL}, dims AS (SELECT item, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM e), means AS (SELECT item, pos, avg(x) AS x FROM dims GROUP BY item, pos),
   raw AS (SELECT item, list(x ORDER BY pos) AS v FROM means GROUP BY item), c AS (SELECT item, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM raw)"""


@query("item_centroids", "V8", f"WITH {CENTROID_SQL} SELECT item, unnest(range(0, 64))::INTEGER AS pos, round(unnest(v), 6) AS x FROM c")
def _(spark, d):
    return r.centroids(photos(spark, d)).select("item", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "centroid_neighbours", "V9",
    f"""WITH {CENTROID_SQL}, p AS (SELECT a.item, b.item AS neighbour, list_dot_product(a.v, b.v) AS score FROM c a JOIN c b ON a.item <> b.item)
        SELECT item, neighbour, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) AS rank FROM p WHERE score <= 0.98) WHERE rank <= 5""",
)
def _(spark, d):
    return r.centroid_neighbours(r.centroids(photos(spark, d)), 5).withColumn("score", F.round("score", 6))


def adapter_weights(dim: int = 64):
    a = np.array([[((i * 7) % 5 - 2) / 10.0 for i in range(dim)]])
    b = np.array([[((i * 3) % 7 - 3) / 10.0] for i in range(dim)])
    return {"label_crop": (a, b)}


ADAPTED_SQL = """ad AS (SELECT id, view, item, CASE WHEN view = 'label_crop' THEN list_transform(range(1, 65), lambda i: v[i] + list_sum(list_transform(range(1, 65), lambda j: v[j] * (((j - 1) * 7) % 5 - 2) / 10.0)) * (((i - 1) * 3) % 7 - 3) / 10.0) ELSE v END AS x FROM e),
   an AS (SELECT id, view, item, list_transform(x, lambda y: y / greatest(sqrt(list_dot_product(x, x)), 1e-12)) AS x FROM ad)"""


@query("adapted_vectors", "V2", f"WITH {E_SQL}, {ADAPTED_SQL} SELECT id, view, unnest(range(0, 64))::INTEGER AS pos, round(unnest(x), 6) AS x FROM an")
def _(spark, d):
    df = r.apply_adapter(photos(spark, d), adapter_weights())
    return df.select("id", "view", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "holdout_report", "V11,V6",
    f"""WITH {E_SQL}, {ADAPTED_SQL}, b AS (SELECT q.id, q.view, q.item AS truth, arg_max(c.item, list_dot_product(q.v, c.v)) AS found FROM e q JOIN e c ON q.view = c.view AND q.id <> c.id GROUP BY ALL),
        a AS (SELECT q.id, arg_max(c.item, list_dot_product(q.x, c.x)) AS found FROM an q JOIN an c ON q.view = c.view AND q.id <> c.id GROUP BY q.id)
        SELECT b.view, count(*) AS queries, round(100.0 * avg((b.found = truth)::INT), 1) AS before_pct, round(100.0 * avg((a.found = truth)::INT), 1) AS after_pct,
          count_if(b.found <> truth AND a.found = truth)::BIGINT AS fixed, count_if(b.found = truth AND a.found <> truth)::BIGINT AS broke FROM b JOIN a USING (id) GROUP BY b.view""",
)
def _(spark, d):
    plain = photos(spark, d)
    adapted = r.apply_adapter(plain, adapter_weights())
    truth = items(spark, d)
    before = r.nearest_item(plain, plain, truth, exclude_self=True)
    after = r.nearest_item(adapted, adapted, truth, exclude_self=True)
    return r.holdout_report(before, after, truth)


@query(
    "photo_scores_per_item", "A8,V12",
    """WITH s AS (SELECT l_partkey AS photo, l_discount - 0.05 AS score FROM lineitem), p AS (SELECT p_partkey AS photo, p_partkey % 100 AS item FROM part)
       SELECT item, round(greatest(0.0, max(score)), 6) AS score FROM s JOIN p USING (photo) GROUP BY item""",
)
def _(spark, d):
    t = Tables(spark, d)
    s = t.lineitem.select(F.col("l_partkey").alias("photo"), (F.col("l_discount") - 0.05).alias("score"))
    p = t.part.select(F.col("p_partkey").alias("photo"), (F.col("p_partkey") % 100).alias("item"))
    return r.best_photo_per_item(s, p).withColumn("score", F.round("score", 6))


@query(
    "photos_per_source", "V13,F28",
    f"""WITH {E_SQL} SELECT split_part(photo_id, '_', 1) AS source, count_if(view = 'original')::BIGINT AS original, count_if(view = 'bottle_crop')::BIGINT AS bottle_crop,
        count_if(view = 'label_crop')::BIGINT AS label_crop, count(*) AS total FROM e GROUP BY 1""",
)
def _(spark, d):
    return r.source_counts(photos(spark, d), list(VIEWS))


@query("ivf_recall", "V3b")
def _(spark, d):
    exact = r.knn_lists(all_view_queries(spark, d), photos(spark, d).drop("item"), K, exclude_self=True)
    return r.recall(exact, r.ivf_lists(all_view_queries(spark, d), photos(spark, d), K, centers=8, probes=4, exclude_self=True))


@query("contrastive_pairs", "V10")
def _(spark, d):
    p = photos(spark, d)
    near = r.centroid_neighbours(r.centroids(p), 3)
    return r.training_pairs(p.select("item", F.col("id").alias("photo"), F.substring_index("photo_id", "_", 1).alias("source")), near)


def hashing_encoder(dim: int = 32):
    def build():
        def run(texts):
            out = np.zeros((len(texts), dim))
            for row, value in enumerate(texts):
                for word in value.split():
                    h = zlib.crc32(word.encode())
                    out[row, h % dim] += 1.0 if h & 1024 else -1.0
            return out

        return run

    return build


@query("encoded_documents", "V1")
def _(spark, d):
    docs = Tables(spark, d).documents.select(
        (F.col("doc_id") % 50).alias("item"), F.col("doc_id").alias("photo"), F.lit("original").alias("view"), "text"
    )
    known = Tables(spark, d).part.select(F.col("p_partkey").alias("item"))
    return r.encode(docs, known, hashing_encoder(), 32, "text", uuid.uuid5(uuid.NAMESPACE_URL, "catalens/point")).select(
        "point_id", "item", "photo", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length")
    )


# --- search-quality evaluation of the self retrieval ----------------------------------------------
EVAL_SQL = f"""{match_sql(K)}{FOLD_SQL},
    pq AS (SELECT q.id AS query, q.item AS expected, min(rank) FILTER (r.item = q.item) AS expected_rank, min(r.item) FILTER (rank = 1) AS top1, min(r.item) FILTER (rank = 2) AS top2,
             min(score) FILTER (rank = 1) AS s1, min(score) FILTER (rank = 2) AS s2, string_agg(r.item::VARCHAR, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 5) AS competitors,
             avg(score) FILTER (rank BETWEEN 2 AND 5) AS mean_2_5
           FROM e q LEFT JOIN ranked r ON r.query = q.id AND r.rank <= 50 GROUP BY q.id, q.item),
    pe AS (SELECT *, coalesce(expected_rank = 1, false) AS correct, CASE WHEN s2 IS NULL THEN 0.0 ELSE s1 - s2 END AS gap FROM pq)"""


def per_query(spark, d):
    truth = photos(spark, d).select(F.col("id").alias("query"), F.col("item").alias("expected"))
    return ev.per_query_eval(self_ranking(spark, d), truth)


@query("eval_per_query", "E1,W5", f"WITH {EVAL_SQL} SELECT query, expected, expected_rank, correct, top1, top2, round(s1, 6) AS s1, round(s2, 6) AS s2, round(gap, 6) AS gap, competitors FROM pe")
def _(spark, d):
    return per_query(spark, d).select("query", "expected", "expected_rank", "correct", "top1", "top2", *[F.round(c, 6).alias(c) for c in ("s1", "s2", "gap")], "competitors")


@query(
    "eval_summary", "E2",
    f"""WITH {EVAL_SQL} SELECT count(*) AS queries, round(avg(correct::INT), 6) AS accuracy_1, round(avg(coalesce(1.0 / expected_rank, 0)), 6) AS mrr, round(avg(s1), 6) AS mean_top1,
        round(avg(s1) FILTER (correct), 6) AS mean_top1_correct, round(avg(s1) FILTER (NOT correct), 6) AS mean_top1_wrong,
        {', '.join(f'round(avg(coalesce(expected_rank <= {k}, false)::INT), 6) AS recall_{k}' for k in (5, 10, 20, 30, 40, 50))} FROM pe""",
)
def _(spark, d):
    return ev.summary_metrics(per_query(spark, d))


@query(
    "eval_per_item", "E3",
    f"""WITH {EVAL_SQL}, p AS (SELECT top1 AS item, count(*) AS predicted FROM pe GROUP BY top1)
        SELECT expected AS item, count(*) AS photos, count_if(correct)::BIGINT AS hits, round(avg(correct::INT), 6) AS accuracy, round(avg(s1), 6) AS mean_top1, min(expected_rank) AS best_rank,
          count_if(correct) = count(*) AS all_right, round(2.0 * count_if(correct) / (count(*) + coalesce(max(predicted), 0)), 6) AS f1
        FROM pe LEFT JOIN p ON p.item = pe.expected GROUP BY expected""",
)
def _(spark, d):
    return ev.per_item_summary(per_query(spark, d))


@query(
    "eval_confidence", "E4,M15,A12",
    f"""WITH {EVAL_SQL}, top AS (SELECT query, 0.7 * max(weight) + 0.3 * sum(weight) AS ceiling FROM wt GROUP BY query),
        cf AS (SELECT query, rank, CASE WHEN ceiling <= 0 THEN 0.0 ELSE least(greatest(score / ceiling, 0), 1) END AS c FROM ranked JOIN top USING (query) WHERE rank <= 5),
        pv5 AS (SELECT query, {', '.join(f'min(c) FILTER (rank = {n}) AS c{n}' for n in range(1, 6))}, avg(c) FILTER (rank >= 2) AS behind FROM cf GROUP BY query),
        x AS (SELECT e.id % 5 <> 0 AS in_catalogue, pv5.*, CASE WHEN c2 IS NULL THEN 0.0 ELSE c1 - c2 END AS lead_2, c1 - behind AS lead_behind, c1 - c5 AS lead_5 FROM e LEFT JOIN pv5 ON pv5.query = e.id)
        SELECT in_catalogue, count(*) AS queries, round(avg(c1), 6) AS mean_f1_1, round(avg((lead_2 > 0.05)::INT), 6) AS share_gap_5, round(avg((lead_2 > 0.10)::INT), 6) AS share_gap_10,
          round(min(lead_5), 6) AS min_lead_5, round(median(behind), 6) AS median_f1_5, round(median(lead_2), 6) AS median_gap, round(median(lead_behind), 6) AS median_lead_behind,
          round(median(lead_5), 6) AS median_lead_5, {', '.join(f'round(median(c{n}), 6) AS median_rank_{n}' for n in range(1, 6))} FROM x GROUP BY in_catalogue""",
)
def _(spark, d):
    matches = materialize(self_matches(spark, d), "matches")
    weights = r.view_weights(matches).groupBy("query").agg(F.collect_list("weight").alias("weights"))  # one per view
    ranked = r.fold_to_items(matches, items(spark, d), ev.CONFIDENCE_RANKS).join(weights, "query")
    truth = photos(spark, d).select(F.col("id").alias("query"), (F.col("id") % 5 != 0).alias("in_catalogue"))
    confident = ranked.select("query", "rank", similarity(F.col("score"), F.col("weights"), F.lit(False)).alias("confidence"))
    rows = materialize(ev.confidence_by_rank(confident, truth), "confidence")
    return ev.confidence_metrics(rows, ["in_catalogue"])


@query(
    "eval_reject_sweep", "E5",
    f"""WITH {EVAL_SQL}, t AS (SELECT unnest(range(0, 21)) / 20.0 AS threshold), x AS (SELECT pe.*, query % 5 <> 0 AS present FROM pe)
        SELECT threshold::DOUBLE AS threshold, round(coalesce(2.0 * count_if(NOT present AND s1 < threshold) / nullif(count_if(NOT present) + count_if(s1 < threshold), 0), 0), 6) AS f1_absent,
          round(avg(CASE WHEN present THEN (correct AND s1 >= threshold)::INT ELSE (s1 < threshold)::INT END), 6) AS accuracy FROM x, t GROUP BY threshold""",
)
def _(spark, d):
    pe = per_query(spark, d).withColumn("present", F.col("query") % 5 != 0)
    return ev.reject_sweep(pe, "present", [i / 20.0 for i in range(21)])
