"""Error reports, their ranking and the patterns in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A criterion is the column (or an expression) whose value is the score, and whether a high one is the worse.
CRITERIA: dict[str, tuple[str | Column, bool]] = {"ap": ("ap", False), "count": ("count", True)}


def register_criterion(name: str, score: str | Column, high_is_worse: bool) -> None:
    """Make a criterion of one's own known to ``rank``."""
    CRITERIA[name] = (score, high_is_worse)


def confusion(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per pair of different classes (in each group of ``by``, so in the other reports): count, mean IoU and confidence, number of images."""
    wrong = matches.where("status = 'match' AND gt_class <> pred_class")
    return wrong.groupBy(*by, "gt_class", "pred_class").agg(
        F.count("*").alias("count"), F.avg("iou").alias("mean_iou"), F.avg("confidence").alias("mean_confidence"), F.countDistinct("image_id").alias("n_images"),
    )


def outcomes(matches: DataFrame, hi: float = 0.8, lo: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """A row for each status, true and predicted class: count, n_iou (known IoUs), high_iou and low_iou; all that counts by class are made of, in one pass."""
    return matches.groupBy(*by, "status", "gt_class", "pred_class").agg(
        F.count("*").alias("count"), F.count("iou").alias("n_iou"), F.count_if(F.col("iou") >= hi).alias("high_iou"), F.count_if(F.col("iou") < lo).alias("low_iou"),
    )


def rates(outcomes: DataFrame) -> DataFrame:
    """Precision and recall of each class from the outcomes of all classes; null where a class has no predictions or no boxes."""
    right = F.when((F.col("status") == "match") & (F.col("gt_class") == F.col("pred_class")), F.col("count")).otherwise(0)
    side = lambda c, name: outcomes.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("class_id")).agg((F.sum(right) / F.sum("count")).alias(name))
    return side("pred_class", "precision").join(side("gt_class", "recall"), "class_id", "full_outer")


def confusion_cases(matches: DataFrame) -> DataFrame:
    return matches.where("status = 'match' AND gt_class <> pred_class").select("image_id", "gt_idx", "pred_idx", "gt_class", "pred_class", "iou", "confidence")


def false_positives(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return matches.where("status = 'fp'").groupBy(*by, F.col("pred_class").alias("class_id")).agg(
        F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.countDistinct("image_id").alias("n_images")
    )


def false_negatives(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return matches.where("status = 'fn'").groupBy(*by, F.col("gt_class").alias("class_id")).agg(F.count("*").alias("count"), F.countDistinct("image_id").alias("n_images"))


def confusion_matrix(matches: DataFrame, classes: Sequence[int]) -> DataFrame:
    """A row for each true class and a column for each predicted one, zeros filled in; right predictions are not counted."""
    wrong = matches.where("status = 'match' AND gt_class <> pred_class")
    found = wrong.groupBy("gt_class").agg(*[F.count_if(F.col("pred_class") == k).alias(f"pred_{k}") for k in classes])
    every = matches.sparkSession.createDataFrame([(int(k),) for k in classes], "gt_class bigint")
    return every.join(found, "gt_class", "left").fillna(0)


def worst_class(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.min_by("class_id", F.struct("ap", "class_id")).alias("class_id"), F.min("ap").alias("ap"))


def dataset_metadata(samples: DataFrame, n_classes: int) -> DataFrame:
    return samples.groupBy("split").agg(F.count("*").alias("n_samples")).withColumn("n_classes", F.lit(n_classes))


def object_distribution(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Objects of each class of the dimension, and their percentage."""
    n = annotations.groupBy("class_id").agg(F.count("*").alias("n"))
    whole = annotations.agg(F.count("*").alias("whole"))
    joined = classes.join(n, "class_id", "left").crossJoin(F.broadcast(whole))  # one row for each class, one row
    share = F.when(F.col("whole") > 0, F.round(100 * F.coalesce("n", F.lit(0)) / F.col("whole"), 4)).otherwise(F.lit(0.0))
    return joined.select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n_objects"), share.alias("percentage"))


def empty_labels(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select("image_id").distinct(), "image_id", "left_anti").agg(F.count("*").alias("n_empty"))


def first_cases(cases: DataFrame, k: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``k`` cases of each group, numbered."""
    return cases.withColumn("case_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("case_no") <= k)


def rank(df: DataFrame, criterion: str, ties: Sequence[str], top_k: int | None = None) -> DataFrame:
    """Worst first, with priority_score; ties in the order of the given columns. top_k null: all, 0 or less: none."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}; there are {sorted(CRITERIA)}")
    column, high = CRITERIA[criterion]
    score = F.col(column) if isinstance(column, str) else column
    out = df.withColumn("priority_score", score.cast("double"))
    if top_k is not None and top_k <= 0:
        return out.limit(0)
    ordered = out.orderBy(F.desc("priority_score") if high else F.asc("priority_score"), *ties)
    return ordered if top_k is None else ordered.limit(top_k)


def policy_score(*scores: Column) -> Column:
    if not scores:
        raise ValueError("a policy needs at least one criterion")
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / len(scores)


def error_table(matches: DataFrame) -> DataFrame:
    """error_type, source_class, target_class, count of all three kinds of error, in one aggregation."""
    kind = F.when(F.col("status") == "fp", "false_positive").when(F.col("status") == "fn", "false_negative").otherwise("confusion")
    wrong = matches.where("status <> 'match' OR gt_class <> pred_class")
    return wrong.groupBy(
        kind.alias("error_type"), F.when(F.col("status") == "fp", F.col("pred_class")).otherwise(F.col("gt_class")).alias("source_class"),
        F.when(F.col("status") == "match", F.col("pred_class")).alias("target_class"),
    ).agg(F.count("*").alias("count"))


def extract_patterns(ranked: DataFrame, min_count: int = 1, top_k: int | None = None) -> DataFrame:
    """Error rows of some weight, by priority_score or else count."""
    score = F.coalesce("priority_score", F.col("count").cast("double")) if "priority_score" in ranked.columns else F.col("count").cast("double")
    out = ranked.where(F.col("count") >= min_count).withColumn("priority", score)
    out = out.orderBy(F.desc("priority"), "error_type", "source_class", F.asc_nulls_first("target_class"))
    return out if top_k is None else out.limit(max(top_k, 0))


def find_patterns(errors: DataFrame, min_counts: dict[str, int] | None = None) -> DataFrame:
    """Patterns with id, score and rank: confusions and misses count double."""
    least = {"confusion": 2, "false_negative": 2, "false_positive": 2} | (min_counts or {})
    kept = errors.where(F.col("count") >= F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("error_type")])
    score = F.when(F.col("error_type") == "false_positive", F.col("count")).otherwise(2 * F.col("count"))
    pattern_id = F.concat_ws("_", "error_type", F.col("source_class").cast("string"), F.when(F.col("target_class").isNotNull(), F.lit("to")), F.col("target_class").cast("string"))
    scored = kept.withColumn("pattern_id", pattern_id).withColumn("score", score.cast("bigint"))
    # A row for each pair of classes and kind at most.
    return scored.withColumn("pattern_rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("count"), "pattern_id")))


def class_priority(patterns: DataFrame) -> DataFrame:
    """2 x confusions + 2 x misses + false alarms of each source class."""
    weight = F.when(F.col("error_type") == "false_positive", 1).otherwise(2)
    return patterns.groupBy(F.col("source_class").alias("class_id")).agg(F.sum(weight * F.col("count")).alias("priority"))


def top_by(df: DataFrame, col: str, k: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(col), *ties).limit(k)
