"""Comparison of two experiments at metric, pair, class, object and image level."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.boxes import confusion_kind
from tessera.operators.matching import box_iou, match_cases


def _status(a: Column, b: Column) -> Column:
    return (
        F.when((a == 0) & (b > 0), "new_error").when((a > 0) & (b == 0), "removed_error").when(b < a, "improved").when(b > a, "regressed").otherwise("unchanged")
    )


def compare_metrics(a: DataFrame, b: DataFrame, metrics: Sequence[str] = ("precision", "recall", "ap")) -> DataFrame:
    """Per class both values and their difference; null where a side is missing."""
    x = a.select("class_id", *[F.col(m).alias(f"base_{m}") for m in metrics])
    y = b.select("class_id", *[F.col(m).alias(f"exp_{m}") for m in metrics])
    both = x.join(y, "class_id", "full_outer")
    return both.withColumns({f"{m}_delta": F.col(f"exp_{m}") - F.col(f"base_{m}") for m in metrics})


def _compare_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    x = a.select(*keys, F.col("count").alias("base_count"), *[F.col(m).alias(f"base_{m}") for m in more])
    y = b.select(*keys, F.col("count").alias("exp_count"), *[F.col(m).alias(f"exp_{m}") for m in more])
    both = x.join(y, list(keys), "full_outer").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("base_count", "exp_count")})
    delta = F.col("exp_count") - F.col("base_count")
    return both.withColumns({
        "delta": delta, "relative_change": F.when(F.col("base_count") > 0, delta / F.col("base_count")), "status": _status(F.col("base_count"), F.col("exp_count")),
    })


def compare_confusions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of classes in two experiments: counts, means of IoU and confidence of both, change, status.

    The kind is that of the experiment, so a pair that it no longer has is ``unknown``.
    """
    out = _compare_counts(a, b, ["gt_class", "pred_class"], ["mean_iou", "mean_confidence"])
    return out.withColumn("kind", confusion_kind(F.col("exp_mean_iou")))


def compare_error_class(a: DataFrame, b: DataFrame) -> DataFrame:
    """False positives or negatives per class: counts, mean confidences where both tables have them, change and status."""
    more = ["mean_confidence"] if "mean_confidence" in a.columns and "mean_confidence" in b.columns else []
    delta = F.col("delta")
    status = F.when(delta > 0, "regressed").when(delta < 0, "improved").otherwise("unchanged")
    return _compare_counts(a, b, ["class_id"], more).withColumn("status", status)


def error_totals(cmp: DataFrame) -> DataFrame:
    """Both totals of a comparison of counts."""
    return cmp.agg(F.sum("base_count").alias("base_total"), F.sum("exp_count").alias("exp_total"))


def comparison_summary(cmp: DataFrame) -> DataFrame:
    return cmp.groupBy("status").agg(F.count("*").alias("n"), F.sum("base_count").alias("base_total"), F.sum("exp_count").alias("exp_total"))


def top_changes(cmp: DataFrame, col: str = "delta", k: int = 5, worst: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    changed = cmp.where(F.col(col) > 0 if worst else F.col(col) < 0)
    return changed.orderBy(F.desc(col) if worst else F.asc(col), *ties).limit(k)


def worst_deltas(cmp: DataFrame, metrics: Sequence[str] = ("recall", "ap", "precision"), k: int = 5) -> DataFrame:
    """metric, place, class_id, delta: for each metric the ``k`` classes whose change is smallest, whatever its sign; ties by class.

    The comparison has a row for each class of the model, so the ranks of a metric are few.
    """
    long = cmp.select("class_id", F.posexplode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_delta").alias("delta")) for m in metrics])).alias("_", "m")).select("class_id", "m.*")
    place = F.row_number().over(Window.partitionBy("metric").orderBy("delta", "class_id"))
    return long.where("delta IS NOT NULL").select("metric", place.alias("place"), "class_id", "delta").where(F.col("place") <= k)


def case_transitions(base: DataFrame, exp: DataFrame, least: float = 0.95, similarity: Callable[[Column, Column], Column] = box_iou) -> DataFrame:
    """What became of each confusion case (image_id, gt_class, pred_class, case_idx, box, iou, confidence).

    Cases are matched one to one by image, true class and box; equal predictions persist, others changed; cases
    without a counterpart were resolved (base) or are new (experiment).
    """
    pairs = match_cases(base, exp, ["gt_class"], least, similarity)
    same = F.when(F.col("l.pred_class") == F.col("r.pred_class"), "persistent_error").otherwise("prediction_changed")
    transition = F.when(F.col("r").isNull(), "confusion_resolved_or_changed").when(F.col("l").isNull(), "new_confusion_case").otherwise(same)
    change = lambda c: (F.col(f"r.{c}") - F.col(f"l.{c}")).cast("double").alias(f"{c}_delta")
    return pairs.select(
        "image_id", "gt_class", F.col("l.case_idx").alias("base_idx"), F.col("r.case_idx").alias("exp_idx"), F.col("l.pred_class").alias("base_pred"), F.col("r.pred_class").alias("exp_pred"),
        change("iou"), change("confidence"), transition.alias("transition"),
    )


def case_persistence(base: DataFrame, exp: DataFrame, least: float = 0.95, similarity: Callable[[Column, Column], Column] = box_iou) -> DataFrame:
    """Per class: cases of both experiments, those that persist, were resolved and are new (image_id, class_id, case_idx, box)."""
    out = match_cases(base, exp, ["class_id"], least, similarity).groupBy("class_id").agg(F.count("l").alias("base_cases"), F.count("r").alias("exp_cases"), F.count("score").alias("persistent"))
    return out.withColumn("resolved", F.col("base_cases") - F.col("persistent")).withColumn("new", F.col("exp_cases") - F.col("persistent"))


def case_statistics(cases: DataFrame, by: Sequence[str], hi: float = 0.8, lo: float = 0.5) -> DataFrame:
    n = F.count("iou")
    high, low = F.count_if(F.col("iou") >= hi), F.count_if(F.col("iou") < lo)
    return cases.groupBy(*by).agg(
        F.count("*").alias("n_cases"), F.avg("iou").alias("mean_iou"), F.avg("confidence").alias("mean_confidence"), high.alias("high_iou"), low.alias("low_iou"),
        F.when(n > 0, high / n).alias("high_iou_ratio"), F.when(n > 0, low / n).alias("low_iou_ratio"),
    )


def focus_classes(base: DataFrame, exp: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Outgoing and incoming confusions of some classes in two experiments."""
    def sides(df: DataFrame, name: str) -> DataFrame:
        ends = [F.struct(F.col(c).alias("class_id"), F.lit(n).alias("direction")) for c, n in (("gt_class", "outgoing"), ("pred_class", "incoming"))]
        both = df.select(F.explode(F.array(*ends)).alias("end"), "count").select("end.*", "count")  # one pass, as a pair's count may be costly
        return both.where(F.col("class_id").isin(list(classes))).groupBy("class_id", "direction").agg(F.sum("count").alias(name))

    joined = sides(base, "base_total").join(sides(exp, "exp_total"), ["class_id", "direction"], "full_outer").fillna(0, ["base_total", "exp_total"])
    return joined.withColumn("delta", F.col("exp_total") - F.col("base_total"))


def error_image_list(matches: DataFrame, base: str = "preds", exp: str = "preds2") -> DataFrame:
    """status, image_id, side: every image with an error of that kind, in both experiments, base_only or exp_only; of the matches of both (``matching.match_experiments``)."""
    rows = matches.where(F.col("experiment").isin(base, exp))
    apart = F.when(F.col("status").isNull() | F.col("image_id").isNull(), F.col("experiment")).alias("_apart")  # an unknown image is not the same in both
    seen = rows.groupBy("status", "image_id", apart).agg(F.bool_or(F.col("experiment") == base).alias("a"), F.bool_or(F.col("experiment") == exp).alias("b"))
    return seen.select("status", "image_id", F.when(~F.col("b"), "base_only").when(~F.col("a"), "exp_only").otherwise("both").alias("side"))


def error_image_sets(matches: DataFrame, base: str = "preds", exp: str = "preds2") -> DataFrame:
    """Per kind of error (status): how many images in both experiments, and in one only."""
    sides = ("both", "base_only", "exp_only")
    return error_image_list(matches, base, exp).groupBy("status").agg(*[F.count_if(F.col("side") == s).alias(s) for s in sides])


def image_set_diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(in both, only in a, only in b)."""
    x, y = a.select("image_id"), b.select("image_id")
    return x.intersect(y), x.subtract(y), y.subtract(x)


def name_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    x, y = expected.select("name"), actual.select("name")
    return x.subtract(y).withColumn("problem", F.lit("missing")).unionByName(y.subtract(x).withColumn("problem", F.lit("unexpected")))


def merge_samples(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union in order, leaving out names that are there already."""
    out = first
    for df in rest:
        out = out.unionByName(df.join(out.select("name").distinct(), "name", "left_anti").select(*first.columns))
    return out


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in order; by an aggregate, so that no key gathers its rows in a task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


REPORT_KEYS = ("split", "per_class_metrics", "class_performance_summary", "error_analysis")


def check_report(report: DataFrame) -> DataFrame:
    """``report`` (a row for each error report) with ``problems``: missing top-level keys, and a split that is not for evaluation.

    A key is missing if its column is absent or null.
    """
    value = lambda k: F.col(k) if k in report.columns else F.lit(None)
    missing = [F.when(value(k).isNull(), F.lit(f"missing:{k}")) for k in REPORT_KEYS]
    split = value("split").cast("string")
    warning = F.when(~F.coalesce(split.isin("val", "test"), F.lit(False)), F.concat(F.lit("warning:split="), F.coalesce(split, F.lit("None"))))
    return report.withColumn("problems", F.array_compact(F.array(*missing, warning)))


def diagnose(metrics: DataFrame, confusions: DataFrame, base_stats: DataFrame, exp_stats: DataFrame, fp: DataFrame, fn: DataFrame, focus: int) -> DataFrame:
    """Diagnostic signals: type, value and, for the dominant confusion, its pair; evidence, not proof of a cause.

    ``metrics``, ``confusions``, ``fp`` and ``fn`` are comparisons, ``*_stats`` the case statistics of all confusions
    (one row each).  The class's recall fell; confusions rose while the share of cases with a high IoU did not fall;
    the share with a low IoU rose; the pair that rose most; false positives and negatives of the class rose.
    """
    pair = [F.lit(None).cast("bigint").alias("gt_class"), F.lit(None).cast("bigint").alias("pred_class")]
    signal = lambda kind, value: [F.lit(kind).alias("signal"), value.cast("double").alias("value")]
    recall = metrics.where((F.col("class_id") == focus) & (F.col("recall_delta") < 0)).select(*signal("recall_regression", F.abs("recall_delta")), *pair)
    total = confusions.agg((F.sum("exp_count") - F.sum("base_count")).alias("total"))
    ratios = [df.select(*[F.col(f"{x}_iou_ratio").alias(f"{n}_{x}") for x in ("high", "low")]) for df, n in ((base_stats, "base"), (exp_stats, "exp"))]
    one = total.crossJoin(ratios[0]).crossJoin(ratios[1])  # one row each
    fell = F.col("base_high").isNotNull() & (F.col("exp_high") < F.col("base_high"))
    kept_high = one.where((F.col("total") > 0) & F.col("exp_high").isNotNull() & ~F.coalesce(fell, F.lit(False))).select(*signal("classification_dominant_regression", F.col("exp_high")), *pair)
    lower = one.where(F.col("exp_low").isNotNull() & (F.col("base_low").isNull() | (F.col("exp_low") > F.col("base_low")))).select(*signal("localization_regression_signal", F.col("exp_low")), *pair)
    rose = confusions.where(F.col("delta") > 0).orderBy(F.desc("delta"), "gt_class", "pred_class").limit(1)
    most = rose.select(*signal("dominant_confusion", F.col("delta")), F.col("gt_class").cast("bigint").alias("gt_class"), F.col("pred_class").cast("bigint").alias("pred_class"))
    rise = lambda df, n: df.where((F.col("class_id") == focus) & (F.col("delta") > 0)).select(*signal(n, F.col("delta")), *pair)
    return recall.unionByName(kept_high).unionByName(lower).unionByName(most).unionByName(rise(fp, "false_positive_increase")).unionByName(rise(fn, "false_negative_increase"))
