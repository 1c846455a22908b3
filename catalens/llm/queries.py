"""Registered corpus queries over the test tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm.common import materialize

import corpus_pipeline
from catalens.llm import chat, decontaminate, html_text, licenses, mixing, neardup, packing, quality, repair, shards, substring, token_counts, whitening
from catalens.llm.tokenizers import tokenizer_path, tokenizer_pattern

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = materialize(quality.features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    judged = quality.judge(featured, quality.fit(featured))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


@query(
    "op5_substring_dedup",
    r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    wins AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
    again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS p FROM again),
    left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) a
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.q) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), scores)
    return out.select("doc_id", "n_pretokens", "n_tokens", F.round("token_score", 4).alias("token_score"))


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.sort_array(F.transform("leaks", lambda x: x["item"])))
    return out.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("item_ids"),
        F.round(F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)), 6).alias("coverage"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: F.size(x["tiles"]))), F.lit(0)).cast("long").alias("n_tiles"),
    )


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shards.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shards.shard_of(F.col("doc_id"), F.col("text"), 9).alias("grown_shard"),
    )


@query("op6_license_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, base = F.transform("base", lambda b: b["start"]), F.transform("base", lambda b: b["label"])
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        licenses.score().alias("score"),
    )


@query("op8_chat_formatting")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    vocabulary, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern()
    convs = chat.conversations(rows)
    read = chat.read_back(chat.branches(convs, vocabulary, pattern), vocabulary, pattern)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    digests = read.select(
        "leaf",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return convs.select("conv_id", "leaf").join(digests, "leaf").drop("leaf")


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    return packing.contents(packed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query(
    "op11_mixing_sources",
    rf"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 15))::BIGINT AS place FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS weight, 3 * source_size AS most FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
        FROM w WINDOW before AS (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, least(weight * (SELECT max(level) FROM l), most::DOUBLE) AS target FROM l),
    q AS (SELECT d.*, k, weight, source_size, target, sum(size) OVER (PARTITION BY k ORDER BY place, doc_id) AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT doc_id, size, k, turn * source_size + sent AS all_sent, (turn * source_size + sent) / weight AS finish FROM q, (VALUES (0), (1), (2)) r(turn) WHERE size > 0),
    m AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, k, all_sent) AS total FROM c),
    n AS (SELECT doc_id, sum(size) AS taken FROM m WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
    SELECT q.doc_id, q.size, q.source_size, round(q.target, 4) AS target, coalesce(n.taken, 0)::BIGINT AS taken FROM q LEFT JOIN n USING (doc_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), F.col("taken").cast("long").alias("taken"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by a checksum of id and turn; rows to be dropped stay, with a flag."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), (fault == 0).alias("dropped"), F.explode(copies).alias("copy"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(damaged(table(spark, sf_dir, "conversations")), dropped=F.col("dropped"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES["pipeline"] = corpus_pipeline.run
