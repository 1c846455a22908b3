"""Ingest, cards, filters and photo views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.operators import cards, ingest
from catalens.plans.registry import Tables, query

C = F.col


@query(
    "validated_parts", "S2",
    """WITH raw AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE ' ' || p_brand END AS brand,
              p_size / 8.0 AS rating, CASE WHEN p_partkey % 3 = 0 THEN (p_size / 2.0)::VARCHAR ELSE ' ' || p_size || ' vol ' END AS alcohol, CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS stock FROM part)
       SELECT p_partkey, name, nullif(trim(brand), '') AS brand, rating,
          CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(regexp_replace(printf('%.4f', alcohol::DOUBLE), '0+$', ''), '\\.$', '') || '%' ELSE nullif(trim(alcohol), '') END AS alcohol,
          TRY_CAST(stock AS INTEGER) AS stock,
          concat_ws('; ', CASE WHEN name = '' THEN 'name: required' END, CASE WHEN stock = 'n/a' THEN 'stock: not int' END, CASE WHEN rating > 5 THEN 'rating: out of range' END) AS reasons
       FROM (SELECT p_partkey, name, brand, rating::DOUBLE AS rating, CASE WHEN p_partkey % 3 = 0 THEN alcohol ELSE alcohol END AS alcohol, stock FROM raw)""",
)
def _(spark, d):
    size = C("p_size")
    raw = Tables(spark, d).part.select(
        "p_partkey", F.when(C("p_partkey") % 50 == 0, "").otherwise(C("p_name")).alias("name"),
        F.when(C("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_brand")).alias("brand"), (size / 8.0).alias("rating"),
        F.when(C("p_partkey") % 3 == 0, (size / 2.0).cast("string")).otherwise(F.concat(F.lit(" "), size.cast("string"), F.lit(" vol "))).alias("alcohol"),
        F.when(C("p_partkey") % 11 == 0, "n/a").otherwise(size.cast("string")).alias("stock"),
    )
    rules = ingest.Rules(required=("p_partkey", "name"), nullable_text=("brand",), casts={"stock": "int"}, ranges={"rating": (0, 5)}, percent=("alcohol",))
    good, rejects = ingest.validate(raw, rules)
    both = good.withColumn("reasons", F.array().cast("array<string>")).unionByName(rejects)
    return both.withColumn("reasons", F.array_join("reasons", "; "))


@query(
    "upserted_parts", "S3",
    """WITH t AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE upper(p_name) END AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 2 = 0)
       SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.p_partkey = t.p_partkey)""",
)
def _(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_name", "p_size")
    source = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(C("p_partkey") % 4 != 0, F.upper("p_name")).alias("p_name"), (C("p_size") + 1).alias("p_size"))
    return ingest.upsert(p.filter("p_partkey % 3 <> 0"), source, ["p_partkey"])


@query("pruned_parts", "S4,J3", "SELECT p_partkey, p_name FROM part WHERE p_partkey::VARCHAR IN (SELECT l_partkey::VARCHAR FROM lineitem WHERE l_discount > 0.09)")
def _(spark, d):
    t = Tables(spark, d)
    source = t.lineitem.filter("l_discount > 0.09").select(C("l_partkey").cast("string").alias("p_partkey"))
    return ingest.prune(t.part.select("p_partkey", "p_name"), source, ["p_partkey"])


@query(
    "order_snapshot_diff", "S5,U3",
    """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
            b AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
       SELECT CASE WHEN b.o_orderkey IS NULL THEN 'delete' WHEN a.o_orderkey IS NULL THEN 'add' ELSE 'keep' END AS action, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
         coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_totalprice, b.o_totalprice) AS o_totalprice FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
)
def _(spark, d):
    t = Tables(spark, d)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    current = o.filter("o_orderdate < '1999-01-01'").drop("o_orderdate")
    wanted = o.filter("o_orderdate >= '1997-01-01'").drop("o_orderdate").withColumn("o_totalprice", C("o_totalprice") + 1)
    parents = t.customer.filter("c_acctbal > 0").select(C("c_custkey").alias("o_custkey"))
    return ingest.snapshot_diff(current, wanted, "o_orderkey", parents, "o_custkey")


@query("conformed_parts", "S15", "SELECT p_partkey, p_size::VARCHAR AS p_size, true AS visible, 0.0::DOUBLE AS rating, p_name FROM part")
def _(spark, d):
    schema = {"p_partkey": ("bigint", None), "p_size": ("string", None), "visible": ("boolean", True), "rating": ("double", 0.0), "p_name": ("string", None)}
    return ingest.conform(ingest.conform(Tables(spark, d).part.select("p_partkey", "p_size", "p_name"), schema), schema)


@query(
    "inventory_counts", "S16,J4",
    """SELECT o_orderpriority, count(f.k) AS found, count(*) - count(f.k) AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') f ON f.k = o_orderkey GROUP BY o_orderpriority""",
)
def _(spark, d):
    t = Tables(spark, d)
    files = t.lineitem.filter("l_returnflag = 'A'").select(C("l_orderkey").alias("o_orderkey"))
    return ingest.inventory_gaps(t.orders.select("o_orderkey", "o_orderpriority"), files, ["o_orderkey"], "o_orderpriority")[0]


@query("inventory_missing", "S16,J4", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(spark, d):
    t = Tables(spark, d)
    files = t.lineitem.filter("l_returnflag = 'A'").select(C("l_orderkey").alias("o_orderkey"))
    return ingest.inventory_gaps(t.orders.select("o_orderkey", "o_orderpriority"), files, ["o_orderkey"], "o_orderpriority")[1]


def card_frame(spark, d):
    """Cards: item = part, grapes = its suppliers, food = nations of its suppliers, region via the brand number, photos = line items."""
    t = Tables(spark, d)
    items = t.part.withColumn("n_nationkey", F.when(C("p_size") > 5, F.regexp_extract("p_brand", "(\\d+)", 1).cast("int")))
    regions = t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select("n_nationkey", C("n_name").alias("region"), C("r_name").alias("country"))
    links = t.lineitem.select(C("l_partkey").alias("p_partkey"), C("l_suppkey").alias("s_suppkey"))
    suppliers = t.supplier.select("s_suppkey", C("s_name").alias("grape"), C("s_nationkey").alias("n_nationkey"))
    grapes = cards.name_lists(links, suppliers.select("s_suppkey", "grape"), "p_partkey", "s_suppkey", "grape", "grapes")
    foods = suppliers.join(t.nation, "n_nationkey").select("s_suppkey", C("n_name").alias("food"))
    food = cards.name_lists(links, foods, "p_partkey", "s_suppkey", "food", "foods")
    photos = t.lineitem.select(
        C("l_partkey").alias("p_partkey"), (C("l_returnflag") == "N").alias("is_generated"), (C("l_linenumber") == 1).alias("is_main"),
        F.concat_ws("/", C("l_orderkey").cast("string"), C("l_linenumber").cast("string"), C("l_suppkey").cast("string")).alias("path"),
    )
    return cards.item_cards(items, "p_partkey", [(regions, "n_nationkey")], [grapes, food, cards.photo_facts(photos, "p_partkey")])


@query(
    "item_cards", "P1,J2",
    """WITH x AS (SELECT l_partkey, l_returnflag = 'N' AS gen, l_linenumber = 1 AS main, l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS path, s_name, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
            g AS (SELECT l_partkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS grapes, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS foods,
                    count_if(NOT gen)::BIGINT AS real_photos, count_if(gen)::BIGINT AS generated_photos FROM x GROUP BY l_partkey),
            f AS (SELECT l_partkey, path AS image_url FROM (SELECT l_partkey, path, row_number() OVER (PARTITION BY l_partkey ORDER BY NOT main, path) AS r FROM x WHERE NOT gen) WHERE r = 1)
       SELECT p_partkey, p_name, p_brand, n.n_name AS region, r_name AS country, coalesce(grapes, '') AS grapes, coalesce(foods, '') AS foods, real_photos, generated_photos, image_url, round(p_retailprice, 2) AS price
       FROM part LEFT JOIN nation n ON p_size > 5 AND n.n_nationkey = regexp_extract(p_brand, '(\\d+)', 1)::INT LEFT JOIN region ON r_regionkey = n.n_regionkey LEFT JOIN g ON g.l_partkey = p_partkey LEFT JOIN f ON f.l_partkey = p_partkey""",
)
def _(spark, d):
    return card_frame(spark, d).select(
        "p_partkey", "p_name", "p_brand", "region", "country", F.coalesce(F.array_join("grapes", ","), F.lit("")).alias("grapes"),
        F.coalesce(F.array_join("foods", ","), F.lit("")).alias("foods"), "real_photos", "generated_photos", "image_url", F.round("p_retailprice", 2).alias("price"),
    )


@query("cards_by_ids", "P2,V12", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_suppkey % 2 = 0)")
def _(spark, d):
    from catalens.functions.values import uuid5
    from catalens.plans.scalars import ITEM_NS

    t = Tables(spark, d)
    parts = t.part.select(uuid5(ITEM_NS, C("p_partkey").cast("string")).alias("item_id"), "p_partkey", "p_name")
    good = t.lineitem.filter("l_quantity > 49 AND l_suppkey % 2 = 0").select(uuid5(ITEM_NS, C("l_partkey").cast("string")).alias("item_id"))
    bad = t.lineitem.filter("l_quantity > 49").select(C("l_partkey").cast("string").alias("item_id"))
    return cards.by_ids(parts, good.unionByName(bad), "item_id").select("p_partkey", "p_name")


@query(
    "evidence_slice", "P3",
    """SELECT l_orderkey, l_partkey, l_suppkey, p_name, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS p_brand, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON p_partkey = l_partkey""",
)
def _(spark, d):
    t = Tables(spark, d)
    ids = t.lineitem.select("l_orderkey", C("l_partkey").alias("p_partkey"), "l_suppkey")
    return cards.evidence_slice(ids, t.part.filter("p_size <> 7"), "p_partkey", ["p_name", "p_brand", "p_type"], "p_brand", "Brand#1").withColumnRenamed("p_partkey", "l_partkey")


@query(
    "filtered_items", "P4",
    """SELECT p_partkey, p_name, skip FROM part, (SELECT unnest(['none', 'p_type', 'words']) AS skip)
       WHERE (skip = 'words' OR (p_name LIKE '%red%' OR p_name LIKE '%small%')) AND (skip = 'p_type' OR p_type IN ('ECONOMY', 'SMALL')) AND coalesce(CASE WHEN p_size % 7 <> 0 THEN p_size / 10.0 END, 0.0) >= 1.5
         AND len(list_filter(['Brand', p_type], lambda x: NOT list_contains([split_part(p_brand, '#', 1), p_type, 'x'], x))) = 0""",
)
def _(spark, d):
    base = Tables(spark, d).part.select(
        "p_partkey", "p_name", "p_type", F.split("p_name", " ").alias("words"), F.when(C("p_size") % 7 != 0, C("p_size") / 10.0).alias("rating"),
        F.array(F.substring_index("p_brand", "#", 1), "p_type", F.lit("x")).alias("dishes"),
    )
    spec = cards.Filters(all_of={"dishes": ["Brand"]}, one_of={"p_type": ["ECONOMY", "SMALL"]}, any_of={"words": ["red", "small"]}, min_rating=1.5)
    flags = F.array_compact(F.array(*[F.when(cards.passes(spec, s), s or "none") for s in (None, "p_type", "words")]))
    return base.select("p_partkey", "p_name", F.explode(flags).alias("skip"))


GROUPS = {"ECONOMY": "budget", "SMALL": "compact", "MEDIUM": "compact"}


@query("grouped_types", "P11", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'budget' WHEN 'SMALL' THEN 'compact' WHEN 'MEDIUM' THEN 'compact' ELSE p_type END AS grp, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    mapping = spark.createDataFrame(list(GROUPS.items()), "raw string, grp string")
    return cards.map_groups(Tables(spark, d).part, "p_type", mapping, "type_group").groupBy(C("type_group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_flags", "P12",
    """SELECT doc_id, regexp_matches(lower(text), 'there|der |que ') AS flag, nullif(regexp_extract(lower(text), '(th[a-z]+tion|ein[a-z]*|[a-z]*aux)', 1), '') AS reason,
         coalesce(nullif(regexp_extract(lower(text), '(licen[a-z]*)', 1), ''), CASE WHEN n_chars >= 2000 THEN 'long text' END) AS taste FROM documents""",
)
def _(spark, d):
    low = F.lower("text")
    return Tables(spark, d).documents.select(
        "doc_id", low.rlike("there|der |que ").alias("flag"), cards.first_match(low, "th[a-z]+tion|ein[a-z]*|[a-z]*aux").alias("reason"),
        F.coalesce(cards.first_match(low, "licen[a-z]*"), F.when(C("n_chars") >= 2000, "long text")).alias("taste"),
    )


# --- detections derived from line items: one order = one photo -----------------------------------
def detections(spark, d):
    x1, y1 = (C("l_partkey") * 7) % 800, (C("l_suppkey") * 13) % 900
    return Tables(spark, d).lineitem.select(
        C("l_orderkey").alias("photo"), F.when(C("l_returnflag") == "A", "bottle").otherwise("label").alias("kind"),
        F.when((C("l_linestatus") == "O") | (C("l_returnflag") == "A"), "original").otherwise("bottle_crop").alias("source"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 20 + C("l_quantity") * 20).alias("x2"),
        (y1 + 30 + C("l_linenumber") * 120).cast("double").alias("y2"), (F.lit(0.1) + C("l_discount") * 8).alias("confidence"),
        F.lit(1000.0).alias("frame_w"), F.lit(1200.0).alias("frame_h"), "l_linenumber", "l_partkey", "l_suppkey",
    )


TIE = ["l_linenumber", "l_partkey", "l_suppkey"]
DET_SQL = """det AS (SELECT l_orderkey AS photo, CASE WHEN l_returnflag = 'A' THEN 'bottle' ELSE 'label' END AS kind,
    CASE WHEN l_linestatus = 'O' OR l_returnflag = 'A' THEN 'original' ELSE 'bottle_crop' END AS source,
    ((l_partkey * 7) % 800)::DOUBLE AS x1, ((l_suppkey * 13) % 900)::DOUBLE AS y1, (l_partkey * 7) % 800 + 20 + l_quantity * 20 AS x2, ((l_suppkey * 13) % 900 + 30 + l_linenumber * 120)::DOUBLE AS y2,
    0.1::DOUBLE + l_discount * 8 AS confidence, 1000.0::DOUBLE AS fw, 1200.0::DOUBLE AS fh, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""


def best_sql(name: str, source: str, w, region: bool) -> str:
    extra = "+ CASE WHEN rx1 IS NULL THEN 0 ELSE 0.25 * greatest(0, least(x2, rx2) - greatest(x1, rx1)) * greatest(0, least(y2, ry2) - greatest(y1, ry1)) / greatest(1, (x2 - x1) * (y2 - y1)) END" if region else ""
    return f"""{name}_v AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, max((x2 - x1) * (y2 - y1)) OVER (PARTITION BY photo) AS mx, count(*) OVER (PARTITION BY photo) AS candidates FROM ({source}) WHERE confidence >= 0.25::DOUBLE),
   {name}_s AS (SELECT *, {w[0]}::DOUBLE * confidence + {w[1]}::DOUBLE * least(greatest(1 - abs((x1 + (x2 - x1) / 2 - fw / 2) / greatest(fw / 2, 1)), 0), 1) + {w[2]}::DOUBLE * area / mx {extra} AS sc FROM {name}_v WHERE mx > 0),
   {name} AS (SELECT * FROM (SELECT photo, confidence, candidates, greatest(0, trunc(x1 - m))::INTEGER AS x1, greatest(0, trunc(y1 - m))::INTEGER AS y1, least(fw, trunc(x2 + m))::INTEGER AS x2, least(fh, trunc(y2 + m))::INTEGER AS y2
      FROM (SELECT *, greatest(x2 - x1, y2 - y1) * 0.04::DOUBLE AS m, row_number() OVER (PARTITION BY photo ORDER BY sc DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM {name}_s) WHERE r = 1) WHERE x2 > x1 AND y2 > y1)"""


CROPS_SQL = f"""{DET_SQL}, {best_sql('bt', "SELECT * FROM det WHERE kind = 'bottle'", cards.BOTTLE_SCORE, False)},
   reg AS (SELECT photo, x1::DOUBLE AS rx1, y1::DOUBLE AS ry1, x2::DOUBLE AS rx2, y2::DOUBLE AS ry2 FROM bt),
   {best_sql('fr', "SELECT det.*, rx1, ry1, rx2, ry2 FROM det LEFT JOIN reg USING (photo) WHERE kind = 'label' AND source = 'original'", cards.LABEL_SCORE, True)},
   {best_sql('nr', "SELECT det.* EXCLUDE (fw, fh), rx2 - rx1 AS fw, ry2 - ry1 AS fh FROM det JOIN reg USING (photo) WHERE kind = 'label' AND source = 'bottle_crop'", cards.LABEL_SCORE, False)},
   crops AS (SELECT p.photo, bt.x1 IS NOT NULL AS has_bottle, bt.x1 AS bottle_x1, bt.y2 AS bottle_y2, CASE WHEN fr.x1 IS NOT NULL THEN 'original' WHEN nr.x1 IS NOT NULL THEN 'bottle_crop' ELSE 'original_fallback' END AS label_source,
       coalesce(fr.x1, nr.x1, 0) AS label_x1, coalesce(fr.y1, nr.y1, 0) AS label_y1, CASE WHEN fr.x1 IS NOT NULL THEN fr.x2 WHEN nr.x1 IS NOT NULL THEN nr.x2 ELSE 1000 END AS label_x2,
       CASE WHEN fr.x1 IS NOT NULL THEN fr.y2 WHEN nr.x1 IS NOT NULL THEN nr.y2 ELSE 1200 END AS label_y2, CASE WHEN fr.x1 IS NOT NULL THEN fr.confidence WHEN nr.x1 IS NOT NULL THEN nr.confidence ELSE 1.0 END AS label_confidence,
       coalesce(bt.candidates, 0) AS bottles, CASE WHEN fr.x1 IS NOT NULL THEN fr.candidates ELSE 0 END AS labels
     FROM (SELECT DISTINCT l_orderkey AS photo FROM lineitem) p LEFT JOIN bt USING (photo) LEFT JOIN fr USING (photo) LEFT JOIN nr USING (photo))"""


def crop_frame(spark, d):
    det = detections(spark, d)
    photos = det.select("photo", "frame_w", "frame_h").distinct()
    return cards.crop_provenance(photos, det, "photo", TIE)


@query("best_bottle_box", "P9", f"WITH {DET_SQL}, {best_sql('bt', chr(10).join(['SELECT * FROM det WHERE kind = ', chr(39) + 'bottle' + chr(39)]), cards.BOTTLE_SCORE, False)} SELECT photo, round(confidence, 6) AS confidence, candidates, x1, y1, x2, y2 FROM bt")
def _(spark, d):
    return cards.best_box(detections(spark, d).filter("kind = 'bottle'"), "photo", cards.BOTTLE_SCORE, TIE).withColumn("confidence", F.round("confidence", 6))


@query("crop_provenance", "P8,P9,J7", f"WITH {CROPS_SQL} SELECT * REPLACE (round(label_confidence, 6) AS label_confidence) FROM crops")
def _(spark, d):
    return crop_frame(spark, d).select(
        "photo", "has_bottle", "bottle_x1", "bottle_y2", "label_source", "label_x1", "label_y1", "label_x2", "label_y2", F.round("label_confidence", 6).alias("label_confidence"), "bottles", "labels"
    )


@query(
    "search_views", "P6,P7,P13",
    f"""WITH {CROPS_SQL}, a AS (SELECT *, CASE WHEN label_source = 'original' THEN greatest(0, label_x2 - label_x1)::BIGINT * greatest(0, label_y2 - label_y1) / 1200000.0 ELSE 0 END::DOUBLE AS ratio FROM crops),
        b AS (SELECT *, label_source = 'original' AND ratio > 0.6 AND label_confidence > 0.5 AS close_up FROM a)
      SELECT photo, round(ratio, 9) AS label_area_ratio, close_up AS label_photo, labels >= 3 AS many_labels, CASE WHEN close_up OR label_source <> 'original_fallback' THEN 'label_crop' WHEN has_bottle THEN 'bottle_crop' ELSE 'original' END AS text_view,
        CASE WHEN labels > 0 THEN 'found' ELSE 'not_found' END AS status,
        CASE WHEN close_up THEN 'label_crop' ELSE array_to_string(list_filter([CASE WHEN labels < 3 THEN 'original' END, CASE WHEN has_bottle THEN 'bottle_crop' END, CASE WHEN label_source <> 'original_fallback' THEN 'label_crop' END], lambda x: x IS NOT NULL), ',') END AS views FROM b""",
)
def _(spark, d):
    out = cards.select_views(crop_frame(spark, d))
    return out.select(
        "photo", F.round("label_area_ratio", 9).alias("label_area_ratio"), "label_photo", "many_labels", cards.text_source_view(C("views")).alias("text_view"),
        cards.status(C("labels")).alias("status"), F.array_join("views", ",").alias("views"),
    )
