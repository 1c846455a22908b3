"""Readers and writers: JSON tables, photo inventories, embeddings, evaluation tables, logs, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.functions.values import source_kind
from catalens.operators.aggregates import one

# --- fixed values: file layouts ---------------------------------------------------------------------
CATALOG_SCHEMAS = {
    "producers": "id string, name string",
    "producer_aliases": "producer_id string, alias string",
    "regions": "id string, name string, country string",
    "grapes": "id string, name string",
    "grape_aliases": "grape_id string, alias string",
    "color_aliases": "color string, alias string",
    "food": "id string, name string",
    "wines": "id string, sku string, name string, producer_id string, region_id string, year int, color string, sugar string, alcohol string, price decimal(10,2), stock int, "
    "description string, serving_temperature string, shade string, source_url string, created_at timestamp, updated_at timestamp, rating decimal(3,2)",
    "wine_grapes": "wine_id string, grape_id string, percentage double",
    "wine_food": "id string, wine_id string, food_id string",
    "wine_images": "id string, wine_id string, source_url string, is_main boolean, is_generated boolean, minio_path string, webp_minio_path string",
    "wine_terms": "id string, term string, letter string, definition string, source_url string",
}
OPTIONAL_TABLES = ("producer_aliases", "wine_terms")
MANIFEST_SCHEMA = "query_id string, image_path string"
TRUTH_SCHEMA = "query_id string, image_path string, expected_slug string, wine_id string, source string"
PREDICTION_SCHEMA = "query_id string, image_path string, image_sha256 string, predicted_slug string, latency_ms long"
QUERY_ID = "^[A-Za-z0-9._-]+$"
PAYLOAD_SCHEMA = (
    "slug string, payload struct<color:string,temperature:string,alcohol:string,alcoholMax:string,category:struct<name:string>,"
    "dishes:array<struct<name:string>>,manufacturer:struct<name:string>>"
)
PHOTO_PATTERNS = ("main", "yandex_*", "vivino_*", "flux_*")
# ----------------------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def read_catalog(spark: SparkSession, directory: str, tables: dict[str, str] = CATALOG_SCHEMAS, optional: tuple[str, ...] = OPTIONAL_TABLES, arrays: bool = True) -> dict[str, DataFrame]:
    """One DataFrame per `<table>.json`, file or folder; a missing optional table is empty.

    `arrays` reads JSON-array files, each by one task; large tables should be JSON lines (`arrays=False`), which split.
    """
    out = {}
    for name, schema in tables.items():
        path = f"{directory}/{name}.json"
        if name in optional and not _exists(spark, path):
            out[name] = spark.createDataFrame([], schema)
        else:
            out[name] = spark.read.schema(schema).option("multiLine", arrays).json(path)
    return out


def glob_to_regex(patterns: tuple[str, ...]) -> str:
    return "^(" + "|".join(p.replace(".", "\\.").replace("*", ".*").replace("?", ".") for p in patterns) + ")$"


def photo_inventory(paths: DataFrame, path: str = "path", patterns: tuple[str, ...] = PHOTO_PATTERNS, file_name: str = "original.jpg") -> DataFrame:
    """File paths `<item>/<photo>/<file>` → item, photo, object name, kind and flags; folders outside the patterns are skipped.

    A folder holding only another extension of the file is reported as missing.
    """
    stem, extension = file_name.rsplit(".", 1)
    pattern = f"([^/]+)/([^/]+)/{stem}\\.([A-Za-z0-9]+)$"
    parts = paths.select(*[F.regexp_extract(path, pattern, i).alias(n) for i, n in ((1, "item"), (2, "photo"), (3, "ext"))]).filter("item <> ''")
    kept = parts.filter(F.col("photo").rlike(glob_to_regex(patterns)))
    rows = kept.groupBy("item", "photo").agg(F.max((F.lower("ext") == extension).cast("int")).alias("_ok"))
    return rows.select(
        "item", "photo", F.concat_ws("/", "item", "photo", F.lit(file_name)).alias("object_name"), (F.col("photo") == "main").alias("is_main"),
        F.startswith("photo", F.lit("flux")).alias("is_generated"), source_kind(F.col("photo")).alias("kind"), (F.col("_ok") == 0).alias("missing"),
    )


def scan_photo_inventory(spark: SparkSession, root: str, patterns: tuple[str, ...] = PHOTO_PATTERNS) -> DataFrame:
    """List photo files below `root`; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return photo_inventory(files, "path", patterns)


def collect_eval_set(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation photos: `<item>/<photo>/<file>` or `<item>/<file>`; the first folder names the expected item."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return eval_paths(files, root.rstrip("/").rsplit("/", 1)[-1])


def eval_paths(files: DataFrame, root_name: str) -> DataFrame:
    tail = F.regexp_extract("path", f"/{root_name}/(.+)$", 1)
    parts = F.split(tail, "/")
    rows = files.filter(F.lower("path").rlike("\\.(jpg|jpeg|png|webp)$")).select("path", parts.alias("p")).filter(F.size("p").isin(2, 3))
    return rows.select("path", F.col("p")[0].alias("expected"), F.when(F.size("p") == 3, F.col("p")[1]).otherwise(F.regexp_replace(F.col("p")[1], "\\.[^.]+$", "")).alias("photo"))


def check_embeddings(df: DataFrame, ids: str, vector: str) -> DataFrame:
    """One row: vectors, distinct dimensions, missing ids, repeated ids; `ok` when all vectors have one dimension and an id."""
    # one pass for the counts, one hash aggregate for repeated ids
    facts = df.agg(
        one("vectors"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.count_if(F.col(ids).isNull()).alias("missing_ids"),
        F.count_if(F.col(vector).isNull() | F.exists(F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")), lambda x: x.isNull())).alias("broken"),
    )
    repeats = df.groupBy(ids).agg(one("n")).filter("n > 1").agg(one("repeated_ids"))
    out = facts.join(F.broadcast(repeats))  # single rows
    return out.withColumn("ok", (F.col("min_dim") == F.col("max_dim")) & (F.col("missing_ids") == 0) & (F.col("broken") == 0))


def collection_name(view: Column, encoder: str, version: str) -> Column:
    return F.concat(F.lit("wine_"), view, F.lit(f"_{encoder}_{version}"))


def write_embeddings(df: DataFrame, path: str, version: str) -> DataFrame:
    """Store vectors partitioned by version and view; views already holding the expected number of rows are skipped.

    Returns (view, expected, written).
    """
    spark = df.sparkSession
    expected = df.groupBy("view").agg(one("expected"))
    if _exists(spark, f"{path}/version={version}"):
        have = spark.read.parquet(path).filter(F.col("version") == version).groupBy("view").agg(one("have"))
        todo = expected.join(have, "view", "left").filter(F.col("have").isNull() | (F.col("have") != F.col("expected")))
    else:
        todo = expected
    todo = todo.select("view", "expected").collect()  # one row per view
    if todo:
        rows = df.filter(F.col("view").isin([r["view"] for r in todo])).withColumn("version", F.lit(version))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "view").parquet(path)
    report = [(r["view"], r["expected"]) for r in todo]
    written = spark.createDataFrame(report, "view string, _n long").select("view", F.lit(True).alias("written"))
    return expected.join(F.broadcast(written), "view", "left").withColumn("written", F.coalesce("written", F.lit(False)))


def stale_versions(spark: SparkSession, path: str, current: str) -> DataFrame:
    """Stored versions other than the current one; partition values only."""
    return spark.read.parquet(path).select("version").distinct().filter(F.col("version") != current)


def drop_stale(spark: SparkSession, path: str, current: str) -> list[str]:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    gone = [r["version"] for r in stale_versions(spark, path, current).collect()]  # one row per version
    for version in gone:
        target = fs_path(f"{path}/version={version}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return gone


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).option("quote", "").csv(path)


def check_manifest(df: DataFrame) -> DataFrame:
    """Manifest rows with the list of their problems: bad or repeated id, empty, absolute or climbing path."""
    rows = df.select(F.regexp_replace("query_id", "\\r$", "").alias("query_id"), F.regexp_replace("image_path", "\\r$", "").alias("image_path"))
    counts = rows.groupBy("query_id").agg(one("_n"))
    path = F.coalesce("image_path", F.lit(""))
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("query_id").rlike(QUERY_ID), F.lit(False)), "bad id"), F.when(F.col("_n") > 1, "repeated id"), F.when(path == "", "empty path"),
        F.when(F.startswith(path, F.lit("/")), "absolute path"), F.when(path.rlike("(^|/)\\.\\.(/|$)"), "climbing path"),
    ))
    return rows.join(counts, "query_id", "left").withColumn("problems", problems).drop("_n")


def read_eval_tables(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest with problems, ground truth, predictions)."""
    manifest = check_manifest(read_tsv(spark, f"{directory}/queries.tsv", MANIFEST_SCHEMA))
    return manifest, read_tsv(spark, f"{directory}/ground_truth.tsv", TRUTH_SCHEMA), spark.read.schema(PREDICTION_SCHEMA).json(f"{directory}/predictions.jsonl")


def verify_checksums(files: DataFrame, listed: DataFrame, key: str, content: str, digest: str = "sha256") -> DataFrame:
    """`listed`: (key, digest). Result per listed file: ok, changed or missing."""
    actual = F.sha2(content, 256) if digest == "sha256" else F.md5(content)
    got = files.select(key, actual.alias("_actual"))
    joined = listed.join(got, key, "left")
    state = F.when(F.col("_actual").isNull(), "missing").when(F.lower("digest") == F.col("_actual"), "ok").otherwise("changed")
    return joined.select(key, state.alias("state"))


def site_payloads(raw: DataFrame) -> DataFrame:
    """Flat columns of cached payloads; a null payload means the item is not on the site."""
    p = F.col("payload")
    return raw.select(
        "slug", p.isNotNull().alias("found"), p["color"].alias("color"), p["temperature"].alias("temperature"), p["alcohol"].alias("alcohol"), p["alcoholMax"].alias("alcohol_max"),
        p["category"]["name"].alias("category"), p["dishes"]["name"].alias("dishes"), p["manufacturer"]["name"].alias("producer"),
    )


def read_site_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One cached JSON document per slug."""
    return site_payloads(spark.read.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def prediction_rows(df: DataFrame) -> DataFrame:
    """Shape of a predictions file: empty slug → null, whole milliseconds."""
    return df.select(
        "query_id", "image_path", "image_sha256", F.when(F.trim("predicted_slug") != "", F.col("predicted_slug")).alias("predicted_slug"), F.round("latency_ms").cast("long").alias("latency_ms"),
    )


def write_predictions(df: DataFrame, path: str) -> None:
    prediction_rows(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_eval_report(df: DataFrame, path: str) -> None:
    """Per-query rows, nested results included, as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


RESPONSE_SCHEMA = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("wine_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("similarity", T.DoubleType())]))


def normalise_response(df: DataFrame, key: str, body: str) -> DataFrame:
    """Nested result JSON → (key, rank, item, score); the id and the score each have a fallback field."""
    rows = df.select(key, F.posexplode(F.from_json(F.get_json_object(body, "$.results"), RESPONSE_SCHEMA)).alias("pos", "r"))
    return rows.select(key, (F.col("pos") + 1).alias("rank"), F.coalesce("r.wine_id", "r.id").alias("item"), F.coalesce("r.score", "r.similarity", F.lit(0.0)).alias("score"))

