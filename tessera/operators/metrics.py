"""Detection metrics: precision, recall and all-points average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import by_image, candidate_pairs, taken_in_images
from tessera.operators.prefix import in_ranges, later_max, running_sums
from tessera.operators.similarity import table_of

IOUS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def matches_by_threshold(preds: DataFrame, gts: DataFrame, ious: Sequence[float]) -> DataFrame:
    """Class-aware matches for each IoU threshold, with as few rows as there are matches.

    Candidates are joined once, at the lowest threshold, and gathered once for each image and class, in order; every
    threshold folds that one array, leaving out what lies below it, so no candidate is copied or shuffled again.
    """
    keys = ["image_id", "class_id"]
    pairs = candidate_pairs(preds, gts, min(ious), keys)
    item = F.struct((-F.col("p_confidence")).alias("o0"), F.col("p_pred_idx").alias("pred_idx"), (-F.col("iou")).alias("o1"), F.col("g_gt_idx").alias("gt_idx"), "iou")
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    free = F.expr("size(array_distinct(c.pred_idx)) = size(c) AND size(array_distinct(c.gt_idx)) = size(c)")
    fold = "aggregate(filter(c, x -> x.iou >= t), slice(c, 1, 0), (acc, x) -> IF(exists(acc, m -> m.pred_idx = x.pred_idx OR m.gt_idx = x.gt_idx), acc, array_append(acc, x)))"
    thresholds = "array(" + ", ".join(f"{float(t)}D" for t in ious) + ")"
    at = lambda taken: F.expr(f"flatten(transform({thresholds}, t -> transform({taken}, m -> struct(t AS threshold, m AS m))))")
    taken = grouped.select(*keys, F.explode(F.when(free, at("filter(c, x -> x.iou >= t)")).otherwise(at(fold))).alias("z"))
    return taken.select("z.threshold", *keys, "z.m.pred_idx", "z.m.gt_idx", (-F.col("z.m.o0")).alias("confidence"), "z.m.iou")


def detection_metrics(preds: DataFrame, gts: DataFrame, ious: Sequence[float] = (0.5,)) -> DataFrame:
    """threshold, class_id, n_gt, n_pred, tp, precision, recall, ap.

    AP is the area under the precision envelope over all points of recall.  Confidence steps are counted first; the
    running counts and the envelope are then taken in ranges of them, so a class may have any number of steps.
    """
    return metrics_of_images(by_image(preds, gts), ious)


def confidence_steps(images: DataFrame, ious: Sequence[float], preds: Sequence[str], gts: str = "gts") -> DataFrame:
    """experiment, threshold, class_id, confidence, n (predictions), hits (those of them that match) and boxes: how many there are of the class whose match, if any, is here.

    Matches are class-aware, for each threshold and array of predictions; all of it is one aggregate over the images.
    """
    runs = [(e, float(t)) for e in preds for t in ious]
    taken = images.select(gts, *preds, *[taken_in_images(e, gts, t, by_class=True).alias(f"m_{i}") for i, (e, t) in enumerate(runs)])
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("experiment"), F.lit(t).alias("threshold"), F.col(f"m_{i}").alias("m")) for i, (e, t) in enumerate(runs)])).alias("e")
    rows = taken.select(gts, *preds, each).select(gts, *preds, "e.experiment", "e.threshold", F.explode_outer("e.m").alias("m")).where("m IS NOT NULL")
    left = lambda field: F.coalesce(*[F.when(F.col("experiment") == e, F.get(e, F.col("m.l"))[field]) for e in preds])
    # A match is of one class, so each row counts for a single one.
    seen = rows.select("experiment", "threshold", F.coalesce(left("class_id"), F.get(gts, F.col("m.r"))["class_id"]).alias("class_id"), left("confidence").alias("confidence"), "m.l", "m.r")
    return seen.groupBy("experiment", "threshold", "class_id", "confidence").agg(
        F.count("l").alias("n"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("confidence").isNotNull()).alias("hits"), F.count("r").alias("boxes"),
    )


def metrics_of_images(images: DataFrame, ious: Sequence[float] = (0.5,), preds: str | Sequence[str] = "preds", gts: str = "gts") -> DataFrame:
    """``detection_metrics`` of images that hold their boxes (``matching.by_image``).

    Of several arrays of predictions all are scored in one pass, and ``experiment`` tells them apart.
    """
    steps = table_of(confidence_steps(images, ious, [preds] if isinstance(preds, str) else preds, gts))
    group = ["experiment", "threshold", "class_id"]
    order = [F.desc("confidence")]
    ranges = in_ranges(steps.where("n > 0").select(F.struct(*group).alias("_key"), "confidence", "n", "hits"), order)
    curve = running_sums(ranges, order, {"seen": "n", "found": "hits"}).withColumn("precision", F.col("found") / F.col("seen"))
    area = later_max(curve, order, "envelope", "precision")
    scored = area.groupBy("_key").agg(F.max("seen").alias("n_pred"), F.max("found").alias("tp"), F.sum(F.col("envelope") * F.col("hits")).alias("area"))
    scored = scored.select("_key.*", "n_pred", "tp", "area")
    n_gt = steps.groupBy(*group).agg(F.sum("boxes").alias("n_gt")).where("n_gt > 0")
    whole = n_gt.join(scored, group, "left")
    n_pred, tp = F.coalesce("n_pred", F.lit(0)), F.coalesce("tp", F.lit(0))
    return whole.select(
        *([] if isinstance(preds, str) else ["experiment"]), "threshold", "class_id", "n_gt", n_pred.alias("n_pred"), tp.alias("tp"),
        F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0)).alias("precision"), (tp / F.col("n_gt")).alias("recall"), F.coalesce(F.col("area") / F.col("n_gt"), F.lit(0.0)).alias("ap"),
    )


def mean_ap(metrics: DataFrame) -> DataFrame:
    """map50, map75 and map50_95, the mean over classes and all of IOUS, which ``metrics`` has to hold for it (else null)."""
    at = lambda t: F.avg(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("ap")))
    return metrics.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.when(F.count_distinct(F.round("threshold", 2)) == len(IOUS), F.avg("ap")).alias("map50_95"))
