"""Greedy box matching, non-max suppression and the joins around them."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import pairing
from tessera.functions.boxes import box_cols, iou
from tessera.operators.bank import cut


def greedy(pairs: DataFrame, keys: Sequence[str], order: Sequence[Column], left: str, right: str) -> DataFrame:
    """Of each group's candidate pairs in order, take those whose two sides are both still free.

    The pairs of a group are folded inside the JVM.  A group where no side occurs twice, the common case, is taken as
    it is.  Groups are images or the like, so their arrays stay small.
    """
    rest = [x for x in pairs.columns if x not in keys]
    item = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    free = F.expr(f"size(array_distinct(c.{left})) = size(c) AND size(array_distinct(c.{right})) = size(c)")
    fold = F.expr(
        f"aggregate(c, slice(c, 1, 0), (acc, x) -> IF(exists(acc, m -> m.{left} = x.{left} OR m.{right} = x.{right}), acc, array_append(acc, x)))"
    )
    taken = grouped.select(*keys, rows_of(F.when(free, F.col("c")).otherwise(fold)).alias("m"))
    return taken.select(*keys, *[F.col(f"m.{x}").alias(x) for x in rest])


def candidate_pairs(preds: DataFrame, gts: DataFrame, least: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pairs of a prediction (p_*) and a box (g_*) of equal keys whose IoU is at least ``least``."""
    p = preds.select(*[F.col(x) if x in keys else F.col(x).alias(f"p_{x}") for x in preds.columns])
    g = gts.select(*[F.col(x) if x in keys else F.col(x).alias(f"g_{x}") for x in gts.columns])
    pairs = p.join(g, list(keys)).withColumn("iou", iou(box_cols("p_"), box_cols("g_")))
    return pairs.where(F.col("iou") >= least)


def paired_sides(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ids: tuple[str, str], score: Callable[[Column, Column], Column], least: float,
    order: Callable[[Column, Column, Column], Sequence[Column]],
) -> DataFrame:
    """A greedy match inside each group of equal keys: keys, l, r (structs of the other columns), score; r is null for a row of the left that is left over, l for one of the right.

    Pairs whose score is at least ``least`` are taken in the order of ``order(l, r, score)`` if both sides are still
    free.  Candidates are found by a join in generated code, which also keeps what has none; only groups where a row
    has two are sorted and folded.  Sides that come by the keys are not shuffled again.  ``ids`` tell the rows of a
    group apart, groups are images or the like, so their arrays stay small; rows of a null key pair with nothing.
    """
    one = lambda df, n: df.select(*keys, F.struct(*[x for x in df.columns if x not in keys]).alias(n))
    a, b = one(left, "l"), one(right, "r")
    v = score(F.col("l"), F.col("r"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    near = a.alias("a").join(b.alias("b"), functools.reduce(operator.and_, [*same, v >= least]), "left_outer")
    near = near.select(*[F.col(f"a.{k}").alias(k) for k in keys], "l", "r", F.when(F.col("r").isNotNull(), v).alias("score"))
    by = [o.alias(f"o{i}") for i, o in enumerate(order(F.col("l"), F.col("r"), F.col("score")))]
    item = F.struct(*by, F.col("l")[ids[0]].alias("li"), F.col("r")[ids[1]].alias("ri"), F.struct("l", "r", "score").alias("z"))
    groups = near.groupBy(*keys).agg(F.collect_list(item).alias("c")).join(b.groupBy(*keys).agg(F.collect_list("r").alias("r")), list(keys), "full_outer")
    kind = {n: df.schema[n].dataType for n, df in (("l", a), ("r", b))} | {"score": near.schema["score"].dataType}
    row = lambda **of: F.struct(*[of.get(n, F.lit(None)).cast(t).alias(n) for n, t in kind.items()])
    # No row in two candidates: all are taken, and rows without one are as they should be.
    free = F.expr("size(array_distinct(c.li)) = size(c) AND size(array_distinct(array_compact(c.ri))) = size(array_compact(c.ri))")
    fold = F.expr("aggregate(array_sort(filter(c, x -> x.ri IS NOT NULL)), slice(c, 1, 0), (acc, x) -> IF(exists(acc, m -> m.li = x.li OR m.ri = x.ri), acc, array_append(acc, x)))")
    groups = groups.select(*keys, "c", F.coalesce("r", F.array().cast(T.ArrayType(kind["r"]))).alias("r"), F.when(F.col("c").isNull() | free, F.col("c")).otherwise(fold).alias("t"), (~free).alias("folded"))
    lost = F.array_distinct(F.transform(F.filter("c", lambda x: ~F.exists("t", lambda m: m["li"] == x["li"])), lambda x: row(l=x["z"]["l"])))
    rest = F.transform(F.filter("r", lambda y: ~F.coalesce(F.array_contains(F.expr("array_compact(t.ri)"), y[ids[1]]), F.lit(False))), lambda y: row(r=y))
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, t) for n, t in kind.items()])))
    rows = rows_of(F.coalesce(F.expr("t.z"), none), F.when(F.col("folded"), lost).otherwise(none), rest)
    return groups.select(*keys, rows.alias("z")).select(*keys, "z.*")


def rows_of(*parts: Column) -> Column:
    """A row for each item of the arrays of a group, which has one at least.

    The outer explode keeps Spark from testing the arrays' sizes first, for which it would fold every group once more.
    """
    return F.explode_outer(F.concat(*parts))


def box_of(x: Column) -> tuple[Column, ...]:
    return x["x1"], x["y1"], x["x2"], x["y2"]


def box_iou(x: Column, y: Column) -> Column:
    """The similarity of two rows with boxes."""
    return iou(box_of(x), box_of(y))


def match_detections(preds: DataFrame, gts: DataFrame, least: float = 0.5, order: str = "confidence", boxes: bool = False) -> DataFrame:
    """Matches, and what is left: status match, fp (a prediction without a box) or fn (a box without a prediction).

    Predictions by falling confidence (or in input order) each take the free box of highest IoU.  Class plays no
    part.  Ties go to the lower box index.  An image that only one side knows counts with all its rows.  With ``boxes``
    the prediction's box (x1, y1, x2, y2) follows.
    """
    if order not in ("confidence", "input"):
        raise ValueError(f"order must be 'confidence' or 'input', not {order!r}")
    box = ["class_id", "x1", "y1", "x2", "y2"]
    first = (lambda x: [-x["confidence"]]) if order == "confidence" else (lambda x: [])
    pairs = paired_sides(
        preds.select("image_id", "pred_idx", "confidence", *box), gts.select("image_id", "gt_idx", *box), ["image_id"], ("pred_idx", "gt_idx"), box_iou, least,
        lambda x, y, v: [*first(x), x["pred_idx"], -v, y["gt_idx"]],
    )
    status = F.when(F.col("r").isNull(), "fp").when(F.col("l").isNull(), "fn").otherwise("match")
    more = [F.col(f"l.{n}").alias(n) for n in box[1:]] if boxes else []
    return pairs.select(
        "image_id", "l.pred_idx", "r.gt_idx", F.col("l.class_id").alias("pred_class"), F.col("r.class_id").alias("gt_class"), "l.confidence", F.col("score").cast("double").alias("iou"), status.alias("status"), *more,
    )


def by_image(preds: DataFrame, gts: DataFrame) -> DataFrame:
    """image_id, preds, gts: the boxes of each image as arrays of structs; an array is null where a side does not know the image."""
    sides = [df.select("image_id", F.struct(*[x for x in df.columns if x != "image_id"]).alias(n)).groupBy("image_id").agg(F.collect_list(n).alias(n)) for df, n in ((preds, "preds"), (gts, "gts"))]
    return sides[0].join(sides[1], "image_id", "full_outer")


def taken_in_images(preds: str, gts: str, least: float, order: str = "confidence", by_class: bool = False) -> Column:
    """The rows of an image's greedy match as ``pairing.ROWS``: positions in the arrays ``preds`` and ``gts`` and their IoU; only matches of equal classes if ``by_class``.

    The image is ``image_id``; rows of a null one pair with nothing.
    """
    if order not in ("confidence", "input"):
        raise ValueError(f"order must be 'confidence' or 'input', not {order!r}")
    falling = order == "confidence"

    @F.arrow_udf(pairing.ROWS)
    def taken(*columns: pa.Array) -> pa.Array:
        return pairing.paired(least, by_class, falling, *columns)

    side = lambda x, idx: [F.col(f"{x}.{n}").cast(f"array<{t}>") for n, t in ((idx, "long"), ("class_id", "long"), *[(c, "double") for c in ("x1", "y1", "x2", "y2")])]
    return taken(F.col("image_id").isNotNull(), *side(preds, "pred_idx"), *side(gts, "gt_idx"), F.col(f"{preds}.confidence").cast("array<double>"))


def match_images(images: DataFrame, least: float = 0.5, order: str = "confidence", boxes: bool = False, preds: str = "preds", gts: str = "gts") -> DataFrame:
    """The rows of ``match_detections`` of images that hold their boxes (``by_image``): nothing is joined, and an image's boxes are matched together with those of other images."""
    return match_experiments(images, [preds], least, order, boxes, gts).drop("experiment")


def match_experiments(
    images: DataFrame, experiments: Sequence[str] = ("preds", "preds2"), least: float = 0.5, order: str = "confidence", boxes: bool = False, gts: str = "gts",
) -> DataFrame:
    """The rows of ``match_images`` for several arrays of predictions of the images, in one pass; ``experiment`` is the array's name."""
    taken = images.select("image_id", gts, *experiments, *[taken_in_images(n, gts, least, order).alias(f"m_{n}") for n in experiments])
    if len(experiments) > 1:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("experiment"), F.col(f"m_{n}").alias("m")) for n in experiments])).alias("e")
        taken = taken.select("image_id", gts, *experiments, each).select("image_id", gts, *experiments, "e.*")
    else:
        taken = taken.withColumn("experiment", F.lit(experiments[0])).withColumnRenamed(f"m_{experiments[0]}", "m")
    # The outer explode keeps Spark from testing the arrays' sizes first, for which it would match twice.
    rows = taken.select("image_id", gts, *experiments, "experiment", F.explode_outer("m").alias("m")).where("m IS NOT NULL")
    r = F.get(gts, F.col("m.r"))

    def left(field: str) -> Column:
        value = F.get(experiments[-1], F.col("m.l"))[field]
        for n in experiments[:-1]:
            value = F.when(F.col("experiment") == n, F.get(n, F.col("m.l"))[field]).otherwise(value)
        return value.alias(field)

    status = F.when(F.col("m.r").isNull(), "fp").when(F.col("m.l").isNull(), "fn").otherwise("match")
    more = [left(n) for n in ("x1", "y1", "x2", "y2")] if boxes else []
    return rows.select(
        "image_id", left("pred_idx"), r["gt_idx"].alias("gt_idx"), left("class_id").alias("pred_class"), r["class_id"].alias("gt_class"), left("confidence"), F.col("m.iou").alias("iou"), status.alias("status"),
        *more, "experiment",
    )


def match_pairs(preds: DataFrame, gts: DataFrame, least: float = 0.5, order: str = "confidence") -> DataFrame:
    """The matches alone."""
    return match_detections(preds, gts, least, order).where("status = 'match'").drop("status")


def match_predictions(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Class-aware match of two prediction sets: equal class, each used once, the first set in its own order."""
    p = a.select("image_id", "class_id", F.col("pred_idx").alias("a_idx"), F.col("confidence").alias("a_conf"), *[F.col(x).alias(f"p_{x}") for x in ("x1", "y1", "x2", "y2")])
    q = b.select("image_id", "class_id", F.col("pred_idx").alias("b_idx"), F.col("confidence").alias("b_conf"), *[F.col(x).alias(f"g_{x}") for x in ("x1", "y1", "x2", "y2")])
    pairs = p.join(q, ["image_id", "class_id"]).withColumn("iou", iou(box_cols("p_"), box_cols("g_"))).where(F.col("iou") >= least)
    kept = pairs.select("image_id", "class_id", "a_idx", "b_idx", "a_conf", "b_conf", "iou")
    return greedy(kept, ["image_id", "class_id"], [F.col("a_idx"), -F.col("iou"), F.col("b_idx")], "a_idx", "b_idx")


def match_cases(base: DataFrame, exp: DataFrame, classes: Sequence[str], least: float = 0.95, similarity: Callable[[Column, Column], Column] = box_iou) -> DataFrame:
    """One-to-one match of error cases of two experiments, best similarity first, as rows of ``paired_sides``.

    ``similarity`` of two cases is the IoU of their boxes unless given, where image and classes agree, else 0; so
    groups of equal image and classes never compete and each is matched by itself.
    """
    exp = cut(exp)  # it is read twice, and its cases may be the result of a match
    return paired_sides(base, exp, ["image_id", *classes], ("case_idx", "case_idx"), similarity, least, lambda x, y, v: [-v, x["case_idx"], y["case_idx"]])


def nms(preds: DataFrame, least: float = 0.45, per_class: bool = False, most: int | None = None) -> DataFrame:
    """Non-max suppression: by falling confidence, a box stays unless it overlaps a kept one by more than ``least``."""
    keys = ["image_id", "class_id"] if per_class else ["image_id"]
    rest = [x for x in preds.columns if x not in keys]
    item = F.struct((-F.col("confidence")).alias("_o0"), F.col("pred_idx").alias("_o1"), *rest)
    grouped = preds.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    out = grouped.select(*keys, F.explode(suppressed("c", least)).alias("m")).select(*keys, *[F.col(f"m.{x}").alias(x) for x in rest])
    if most is not None:
        by = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "pred_idx")
        out = out.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")
    return out.select(*preds.columns)


def suppressed(c: str, least: float) -> Column:
    """Of a sorted array of boxes those that overlap none kept before by more than ``least``."""
    inter = "greatest(0D, least(m.x2, x.x2) - greatest(m.x1, x.x1)) * greatest(0D, least(m.y2, x.y2) - greatest(m.y1, x.y1))"
    # IoU > t without a division: intersection > t * union, the union never being negative.
    union = f"((m.x2 - m.x1) * (m.y2 - m.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - {inter})"
    return F.expr(f"aggregate({c}, slice({c}, 1, 0), (acc, x) -> IF(exists(acc, m -> {union} > 0 AND {inter} / nullif({union}, 0D) > {float(least)}D), acc, array_append(acc, x)))")

def diff_cases(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id", "gt_class", "pred_class")) -> DataFrame:
    """Error keys of two experiments: improved (gone), regressed (new) or unchanged."""
    x = a.groupBy(*keys).agg(F.count("*").alias("base_count"))
    y = b.groupBy(*keys).agg(F.count("*").alias("exp_count"))
    status = F.when(F.col("exp_count").isNull(), "improved").when(F.col("base_count").isNull(), "regressed").otherwise("unchanged")
    return x.join(y, list(keys), "full_outer").select(*keys, F.coalesce("base_count", F.lit(0)).alias("base_count"), F.coalesce("exp_count", F.lit(0)).alias("exp_count"), status.alias("status"))


def attach_cases(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases of the ranked (few) class pairs."""
    return cases.join(ranked, ["gt_class", "pred_class"])


def attach_weights(images: DataFrame, weights: DataFrame) -> DataFrame:
    return images.join(weights, "image_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def orphans(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """Images without a label and labels without an image."""
    a = images.join(labels, key, "left_anti").select(key, F.lit("image_without_label").alias("problem"))
    return a.unionByName(labels.join(images, key, "left_anti").select(key, F.lit("label_without_image").alias("problem")))


def count_mismatch(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of rows differ between two tables."""
    x = expected.groupBy(key).agg(F.count("*").alias("expected"))
    y = actual.groupBy(key).agg(F.count("*").alias("actual"))
    both = x.join(y, key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("expected <> actual")
