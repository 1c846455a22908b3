"""Search-quality evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.operators.aggregates import exact_quantiles_of, one


def per_query_eval(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per query: rank of the expected item, top two, gap, competitors 2..5.

    `ranked`: (query, item, rank, score); `truth`: (query, expected).
    """
    at = lambda n, c: F.min(F.when(F.col("rank") == n, F.col(c)))
    rivals = F.collect_list(F.when(F.col("rank").between(2, 5), F.struct("rank", F.col("item").cast("string").alias("item"))))
    joined = truth.join(ranked, "query", "left")
    rows = joined.groupBy("query", "expected").agg(
        F.min(F.when(F.col("item") == F.col("expected"), F.col("rank"))).alias("expected_rank"),
        at(1, "item").alias("top1"), at(2, "item").alias("top2"), at(1, "score").alias("s1"), at(2, "score").alias("s2"),
        F.array_sort(rivals).alias("_rivals"), F.avg(F.when(F.col("rank").between(2, 5), F.col("score"))).alias("mean_2_5"),
    )
    names = F.array_join(F.transform("_rivals", lambda x: x["item"]), ",")
    return (
        rows.withColumn("correct", F.coalesce(F.col("expected_rank") == 1, F.lit(False)))
        .withColumn("gap", F.when(F.col("s2").isNull(), 0.0).otherwise(F.col("s1") - F.col("s2")))
        .withColumn("competitors", F.when(F.size("_rivals") > 0, names))
        .drop("_rivals")
    )


def _share(condition: Column) -> Column:
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("int")), 6)


def summary_metrics(per_query: DataFrame, depths: tuple[int, ...] = (5, 10, 20, 30, 40, 50)) -> DataFrame:
    """Accuracy@1, MRR (missing counts 0), mean top-1 scores, recall at several depths."""
    correct = F.col("correct")
    return per_query.agg(
        one("queries"), _share(correct).alias("accuracy_1"), F.round(F.avg(F.coalesce(1.0 / F.col("expected_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg("s1"), 6).alias("mean_top1"), F.round(F.avg(F.when(correct, F.col("s1"))), 6).alias("mean_top1_correct"),
        F.round(F.avg(F.when(~correct, F.col("s1"))), 6).alias("mean_top1_wrong"),
        *[_share(F.col("expected_rank") <= k).alias(f"recall_{k}") for k in depths],
    )


def per_item_summary(per_query: DataFrame) -> DataFrame:
    """Per expected item: photos, hits, accuracy, mean top-1 score, best rank, all right, F1."""
    predicted = per_query.groupBy(F.col("top1").alias("item")).agg(one("_predicted"))
    rows = per_query.groupBy(F.col("expected").alias("item")).agg(
        one("photos"), F.count_if("correct").alias("hits"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"),
        F.round(F.avg("s1"), 6).alias("mean_top1"), F.min("expected_rank").alias("best_rank"),
    )
    f1 = 2.0 * F.col("hits") / (F.col("photos") + F.coalesce("_predicted", F.lit(0)))
    return rows.join(predicted, "item", "left").withColumn("all_right", F.col("hits") == F.col("photos")).withColumn("f1", F.round(f1, 6)).drop("_predicted")


CONFIDENCE_RANKS = 5


def confidence_by_rank(ranked: DataFrame, truth: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row per query of `truth` (query, …): confidence c1..c5 of its first five answers, their mean behind the first, the first one's leads.

    `ranked`: (query, rank, confidence in 0..1). Ranks without an answer are NULL; a single answer leads by 0, as in `per_query_eval`.
    """
    at = lambda n: F.min(F.when(F.col("rank") == n, F.col(confidence)))
    behind = F.avg(F.when(F.col("rank").between(2, CONFIDENCE_RANKS), F.col(confidence)))
    rows = ranked.filter(F.col("rank") <= CONFIDENCE_RANKS).groupBy("query").agg(*[at(n).alias(f"c{n}") for n in range(1, CONFIDENCE_RANKS + 1)], behind.alias("behind"))
    rows = truth.join(rows, "query", "left")
    return rows.withColumns({
        "lead_2": F.when(F.col("c2").isNull(), 0.0).otherwise(F.col("c1") - F.col("c2")), "lead_behind": F.col("c1") - F.col("behind"), f"lead_{CONFIDENCE_RANKS}": F.col("c1") - F.col(f"c{CONFIDENCE_RANKS}"),
    })


def confidence_metrics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Confidence of the first answer, of those behind it and of each rank, with the leads of the first: means, medians, shares of clear leads.

    `rows`: see `confidence_by_rank`. All medians come from one sketch and one count.
    """
    last = f"lead_{CONFIDENCE_RANKS}"
    sums = rows.groupBy(*groups).agg(
        one("queries"), F.round(F.avg("c1"), 6).alias("mean_f1_1"), _share(F.col("lead_2") > 0.05).alias("share_gap_5"), _share(F.col("lead_2") > 0.10).alias("share_gap_10"),
        F.round(F.min(last), 6).alias(f"min_{last}"),
    )
    medians = {"median_f1_5": "behind", "median_gap": "lead_2", "median_lead_behind": "lead_behind", f"median_{last}": last, **{f"median_rank_{n}": f"c{n}" for n in range(1, CONFIDENCE_RANKS + 1)}}
    found = exact_quantiles_of(rows, groups, {name: (column, 0.5, True) for name, column in medians.items()})
    return sums.join(found.select(*groups, *[F.round(name, 6).alias(name) for name in medians]), groups, "left")


def reject_sweep(per_query: DataFrame, present: str, thresholds: list[float]) -> DataFrame:
    """Answer "not found" below a threshold: F1 of the absent class and overall accuracy, per threshold."""
    t, s, here = F.col("threshold"), F.col("s1"), F.col(present)
    rows = per_query.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    rejected = s < t
    absent, said = F.count_if(~here), F.count_if(rejected)
    f1 = F.when(absent + said > 0, 2.0 * F.count_if(~here & rejected) / (absent + said)).otherwise(0.0)
    right = F.when(here, F.col("correct") & ~rejected).otherwise(rejected)
    return rows.groupBy("threshold").agg(F.round(f1, 6).alias("f1_absent"), _share(right).alias("accuracy"))


def latency_report(df: DataFrame, groups: list[str], millis: str, sla: float = 3000.0) -> DataFrame:
    """Mean, median, p95 (nearest rank), maximum and the share answered within the agreed time."""
    base = df.groupBy(*groups).agg(one("requests"), F.round(F.avg(millis), 4).alias("mean"), F.max(millis).alias("max"), _share(F.col(millis) < sla).alias("within_sla"))
    marks = exact_quantiles_of(df, groups, {"p95": (millis, 0.95, False), "median": (millis, 0.5, True)}).withColumn("median", F.round("median", 4))
    if not groups:
        return base.join(F.broadcast(marks))  # single rows
    return base.join(marks, groups)


def join_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions next to the expected slug; empty expected = absent, a NULL prediction is wrong."""
    expected = F.when(F.trim("expected_slug") != "", F.col("expected_slug"))
    joined = truth.withColumn("expected_slug", expected).join(predictions.select("query_id", "predicted_slug", "latency_ms"), "query_id", "left")
    return joined.withColumn("present", F.col("expected_slug").isNotNull()).withColumn(
        "correct", F.coalesce(F.col("predicted_slug") == F.col("expected_slug"), F.lit(False))
    )
