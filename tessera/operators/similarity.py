"""Nearest-neighbour search over embeddings and hard-example mining."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block, and objects of a part of the index.
QUERY_BLOCK, INDEX_PART = 4096, 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; unlike lengths and zero vectors are errors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    bad = (F.size(a) != F.size(b)) | (norm == 0)
    return F.when(bad, F.raise_error(F.lit("vectors must have one length and not be zero")).cast("double")).otherwise(dot(a, b) / norm)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    if (n == 0).any():
        raise ValueError("a zero vector has no direction")
    return x / n[:, None]


def knn(queries: DataFrame, index: DataFrame, k: int, same_class: str | None = None, per_class: bool = True, other_than_self: bool = False) -> DataFrame:
    """case_id, class_id, object_id, similarity, rank: the ``k`` nearest objects of each query, per class of object.

    Rows without a vector, on either side, take no part; a zero vector fails the job.  Objects without a class are found
    only if neither ``per_class`` nor ``same_class`` asks for one.  For an index that is kept and searched again see
    ``operators.index``.

    ``same_class`` names the query's column that an object's class must equal.  ``other_than_self`` leaves out the
    object whose id is the query's own.  Exact: queries are dealt to blocks and the index to parts, each block meets
    each part in a task of its own, which returns a local top k for each query and class; the global top k is a
    ranked window over these.  Nothing passes through the driver.  Similarity is rounded to 4 decimals before it is
    ranked; ties go to the smaller object.
    """
    spark = queries.sparkSession
    queries, index = (df.where(F.col("embedding").isNotNull()) for df in (queries, index))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // INDEX_PART)), -(-index.count() // (8 * INDEX_PART)))
    dealt = lambda df, id_col, own, own_n, other, other_n: (
        df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
    )
    wanted = F.col(same_class).cast("int") if same_class else F.lit(None).cast("int")
    q = dealt(queries.select(F.col("case_id").cast("long").alias("case_id"), wanted.alias("wanted"), "embedding"), "case_id", "block", blocks, "part", parts)
    x = dealt(index.select(F.col("object_id").cast("long").alias("object_id"), F.col("class_id").cast("int").alias("class_id"), "embedding"), "object_id", "part", parts, "block", blocks)

    def search(some: pd.DataFrame, objects: pd.DataFrame) -> pd.DataFrame:
        return _search(some, objects, k, same_class is not None, per_class, other_than_self)

    schema = "case_id long, class_id int, object_id long, similarity double"
    local = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInPandas(search, schema)
    by = ["case_id", "class_id"] if per_class else ["case_id"]
    w = Window.partitionBy(*by).orderBy(F.desc("similarity"), "object_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(some: pd.DataFrame, objects: pd.DataFrame, k: int, same_class: bool, per_class: bool, other_than_self: bool) -> pd.DataFrame:
    """The local top k of a block of queries in a part of the index."""
    empty = pd.DataFrame({"case_id": np.zeros(0, np.int64), "class_id": np.zeros(0, np.int32), "object_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
    if not len(some) or not len(objects):
        return empty
    objects = objects.sort_values("object_id")
    q, x = (_unit(np.stack([np.asarray(v, float) for v in df["embedding"]])) for df in (some, objects))
    ids, own, classes = some["case_id"].to_numpy(np.int64), objects["object_id"].to_numpy(np.int64), objects["class_id"].to_numpy()
    out = [empty]
    for c in np.unique(classes) if per_class or same_class else [None]:
        at = np.flatnonzero(classes == c) if c is not None else np.arange(len(own))
        rows = np.flatnonzero(some["wanted"].to_numpy() == c) if same_class else np.arange(len(q))
        for a in range(0, len(rows), 512):
            some_rows = rows[a : a + 512]
            sims = np.round(q[some_rows] @ x[at].T, 4)
            if other_than_self:
                sims[ids[some_rows][:, None] == own[at][None, :]] = -np.inf
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(sims, top, axis=1)
            i, j = np.nonzero(np.isfinite(best))
            obj = at[top[i, j]]
            out.append(pd.DataFrame({"case_id": ids[some_rows[i]], "class_id": classes[obj], "object_id": own[obj], "similarity": best[i, j]}))
    return pd.concat(out)


def margins(cases: DataFrame, neighbours: DataFrame, missing: str = "null") -> DataFrame:
    """Best similarity in the predicted class less that in the true one; nearest class is the predicted one if positive.

    ``missing``: a class without objects counts 0.0 ('zero'), or leaves the margin null ('null').
    """
    if missing not in ("zero", "null"):
        raise ValueError("missing must be 'zero' or 'null'")
    best = neighbours.groupBy("case_id", "class_id").agg(F.max("similarity").alias("best"))
    joined = cases.select("case_id", "gt_class", "pred_class").join(best, "case_id", "left").groupBy("case_id", "gt_class", "pred_class").agg(
        F.max(F.when(F.col("class_id") == F.col("gt_class"), F.col("best"))).alias("gt_best"), F.max(F.when(F.col("class_id") == F.col("pred_class"), F.col("best"))).alias("pred_best"),
    )
    fill = (lambda v: F.coalesce(v, F.lit(0.0))) if missing == "zero" else (lambda v: v)
    margin = F.round(fill(F.col("pred_best")) - fill(F.col("gt_best")), 4)
    if missing == "null":
        margin = F.when(F.col("gt_class") != F.col("pred_class"), margin)
    out = joined.withColumn("margin", margin)
    return out.withColumn("nearest_class", F.when(F.col("margin") > 0, F.col("pred_class")).when(F.col("margin").isNotNull(), F.col("gt_class")))


def _ten_thousandths(v: Column) -> Column:
    """Sum of values of four decimals as whole numbers, so that means do not depend on the order of rows."""
    return F.sum(F.round(v * 10000))


def similarity_report(m: DataFrame) -> DataFrame:
    """level, gt_class, pred_class and statistics for each pair of classes and, as level ``overall``, for all cases.

    n_cases counts every case, n_margins those with a margin; shares of the nearest class are of all cases.  The mean
    margin is 0 where there is none; the verdict is the mean's at +-0.05.  Pairs and the overall row are one aggregate.
    """
    n, s = F.count("margin"), _ten_thousandths(F.col("margin"))
    pred, gt = F.count_if("_pred"), F.count_if("_gt")
    flagged = m.withColumn("_pred", F.col("nearest_class") == F.col("pred_class")).withColumn("_gt", F.col("nearest_class") == F.col("gt_class"))
    return flagged.groupingSets([[F.col("gt_class"), F.col("pred_class")], []], "gt_class", "pred_class").agg(
        F.when(F.grouping("gt_class") == 1, "overall").otherwise("pair").alias("level"), F.count("*").alias("n_cases"), n.alias("n_margins"), pred.alias("nearest_pred"), gt.alias("nearest_gt"),
        F.round(100 * pred / F.count("*"), 4).alias("nearest_pred_pct"), F.round(100 * gt / F.count("*"), 4).alias("nearest_gt_pct"),
        F.coalesce(F.when(n > 0, F.round(s / n) / 10000), F.lit(0.0)).alias("avg_margin"), F.round(F.min("margin"), 4).alias("min_margin"), F.round(F.max("margin"), 4).alias("max_margin"),
        F.when(s > 500 * n, "closer_to_predicted").when(s < -500 * n, "closer_to_true").otherwise("ambiguous").alias("verdict"),
    ).where("n_cases > 0")


def nearest_classes(m: DataFrame) -> DataFrame:
    """nearest_class, its cases, and their percentage of all cases, those without a nearest class included."""
    whole = m.agg(F.count("*").alias("whole"))  # one row
    n = m.where("nearest_class IS NOT NULL").groupBy("nearest_class").agg(F.count("*").alias("n_cases"))
    return n.crossJoin(F.broadcast(whole)).select("nearest_class", "n_cases", F.round(100 * F.col("n_cases") / F.col("whole"), 4).alias("percentage"))


def build_index(annotations: DataFrame, embed, classes: Sequence[int]) -> DataFrame:
    """object_id, class_id, embedding of the wanted classes' objects; those whose embedding fails (null) are skipped.

    ``embed``: a column function or pandas UDF over the column ``crop``.
    """
    wanted = annotations.where(F.col("class_id").isin(list(classes)) & F.col("crop").isNotNull())
    return wanted.select("object_id", "class_id", embed(F.col("crop")).alias("embedding")).where(F.col("embedding").isNotNull())


def pattern_candidates(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """Objects that can teach each pattern: of source and target class for a confusion, of the source class otherwise."""
    classes = F.when(F.col("error_type") == "confusion", F.array("source_class", "target_class")).otherwise(F.array("source_class"))
    small = patterns.select("pattern_id", F.explode(classes).alias("class_id"))  # two rows for each pattern at most
    return index.join(small, "class_id")


def mine_objects(cases: DataFrame, index: DataFrame, k: int, other_than_self: bool = False) -> DataFrame:
    """Objects of each case's true class among its ``k`` nearest: how often chosen, best similarity, by whom, and rank."""
    near = knn(cases, index, k, same_class="gt_class", other_than_self=other_than_self)
    chosen = near.groupBy("object_id", "class_id").agg(
        F.count("*").alias("selection_count"), F.max("similarity").alias("max_similarity"), F.array_sort(F.collect_list(F.struct("case_id", "rank", "similarity"))).alias("selected_by")
    )
    return ranked_objects(chosen, [F.desc("selection_count"), F.desc("max_similarity"), F.col("object_id")])


def table_of(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that all executors share."""
    from tessera.operators.bank import cut

    return cut(df)


def ranked_objects(chosen: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Global rank 1..n in two levels: rows are range-partitioned in order, and each partition adds the rows before it."""
    spark = chosen.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id") - F.shiftleft("_part", 33))
    # A table, so that both of its readers see the same ranges even if an executor is lost.
    numbered = table_of(numbered)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").withColumn("global_rank", F.col("_before") + F.col("_in") + 1).drop("_id", "_part", "_in", "_before")


def mine_confusions(ranked: DataFrame, cases: DataFrame, index: DataFrame, k: int, cap: int, other_than_self: bool = False) -> DataFrame:
    """For each ranked confusion the objects nearest to its cases: best similarity, matched cases, at most ``cap`` each."""
    mine = cases.join(ranked.select("gt_class", "pred_class", "confusion_rank"), ["gt_class", "pred_class"])
    near = knn(mine, index, k, same_class="gt_class", other_than_self=other_than_self).join(mine.select("case_id", "confusion_rank", "gt_class", "pred_class"), "case_id")
    agg = near.groupBy("confusion_rank", "gt_class", "pred_class", "object_id").agg(F.max("similarity").alias("max_similarity"), F.count("*").alias("matched_cases"))
    w = Window.partitionBy("confusion_rank").orderBy(F.desc("max_similarity"), F.desc("matched_cases"), "object_id")
    return agg.withColumn("object_rank", F.row_number().over(w)).where(F.col("object_rank") <= cap)


def mine_pattern(patterns: DataFrame, cases: DataFrame, index: DataFrame, k: int, other_than_self: bool = False) -> DataFrame:
    """For each pattern, the ``k`` nearest candidate objects of each of its cases (cases carry pattern_id)."""
    near = knn(cases, index, k, other_than_self=other_than_self)
    allowed = pattern_candidates(patterns, index.select("class_id").distinct()).select("pattern_id", "class_id")
    found = near.join(cases.select("case_id", "pattern_id"), "case_id").join(allowed, ["pattern_id", "class_id"])
    w = Window.partitionBy("pattern_id", "case_id").orderBy(F.desc("similarity"), "object_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def check_cases(cases: DataFrame, gt_class: int, pred_class: int) -> DataFrame:
    """The problems of each case: unexpected classes or missing fields."""
    fields = ["image_path", "gt_class", "pred_class", "gt_bbox", "pred_bbox", "iou", "confidence"]
    codes = [F.when(F.col(f).isNull(), F.lit(f"missing_{f}")) for f in fields]
    codes += [F.when(F.col("gt_class") != gt_class, F.lit("wrong_gt_class")), F.when(F.col("pred_class") != pred_class, F.lit("wrong_pred_class"))]
    return cases.withColumn("problems", F.array_compact(F.array(*codes)))


def audit_mined(samples: DataFrame, train_images: DataFrame) -> DataFrame:
    """Mined samples with their errors, and ``keep``: valid, and the first of its key by confusion rank and position.

    Columns: image_path, bbox (array), class_name, similarity, matched_test_cases, in_train, confusion_rank, position.
    Missing keys are the only error of their sample.  ``train_images`` (image_path) are the files that are there.
    """
    images = train_images.select(F.col("image_path").alias("_known")).distinct()
    s = samples.join(images, F.col("image_path") == F.col("_known"), "left")
    needed = ["bbox", "class_name", "image_path", "matched_test_cases", "similarity"]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in needed]))
    corner = lambda i: F.get("bbox", F.lit(i))
    four = F.size("bbox") == 4
    sim = F.col("similarity")
    codes = [
        F.when(~F.coalesce("in_train", F.lit(False)), "not_train_sample").when(F.col("_known").isNull(), "image_not_found"),
        F.when(~four, "invalid_bbox_length").when(F.exists("bbox", lambda v: v.isNull()), "invalid_bbox_values").when((corner(2) <= corner(0)) | (corner(3) <= corner(1)), "invalid_bbox"),
        F.when(F.isnan(sim) | ~sim.between(-1, 1), "invalid_similarity"), F.when(F.col("matched_test_cases") < 1, "invalid_matched_test_cases"),
    ]
    s = s.withColumn("errors", F.when(F.size(missing) > 0, F.array(F.lit("missing_keys"))).otherwise(F.array_compact(F.array(*codes)))).drop("_known")
    key = F.concat_ws("|", "image_path", F.concat_ws(",", F.transform("bbox", lambda v: F.format_string("%.4f", v.cast("double")))))
    s = s.withColumn("object_key", F.when(F.size("errors") == 0, key))
    first = s.where("object_key IS NOT NULL").groupBy("object_key").agg(F.min(F.struct("confusion_rank", "position")).alias("_first"))
    s = s.join(first, "object_key", "left")
    return s.withColumn("keep", F.coalesce(F.struct("confusion_rank", "position") == F.col("_first"), F.lit(False))).drop("_first")


def audit_statistics(audited: DataFrame) -> DataFrame:
    """Totals of ``audit_mined``."""
    bad = F.size("errors") > 0
    return audited.agg(F.count("*").alias("total_samples"), F.count_if("keep").alias("valid_samples"), F.count_if(bad).alias("invalid_samples"), F.count_if(~bad & ~F.col("keep")).alias("duplicate_samples"))


def audited_manifest(audited: DataFrame) -> DataFrame:
    """The kept samples by falling similarity, then matches."""
    return audited.where("keep").orderBy(F.desc("similarity"), F.desc("matched_test_cases"), "object_key")


def hard_manifest(mined: DataFrame) -> DataFrame:
    """Manifest order: selection_count x max_similarity, then count, then similarity."""
    scored = mined.withColumn("score", F.round(F.col("selection_count") * F.col("max_similarity"), 6)).drop("global_rank")
    return ranked_objects(scored, [F.desc("score"), F.desc("selection_count"), F.desc("max_similarity"), F.col("object_id")])


def mining_stats(objects: DataFrame) -> DataFrame:
    """Objects, copies and share of each class and selection count."""
    return objects.groupBy("class_id", "selection_count").agg(F.count("*").alias("n_objects"), F.sum("selection_count").alias("n_copies"))


def image_weights(images: DataFrame, hard: DataFrame, weight: float = 3.0) -> DataFrame:
    if weight <= 0:
        raise ValueError("weight must be positive")
    flagged = images.join(hard.select("image_id").distinct().withColumn("_hard", F.lit(True)), "image_id", "left")
    return flagged.withColumn("weight", F.when(F.col("_hard"), F.lit(float(weight))).otherwise(F.lit(1.0))).drop("_hard")


def weight_stats(weights: DataFrame) -> DataFrame:
    return weights.agg(F.count("*").alias("n_images"), F.count_if(F.col("weight") > 1).alias("n_hard"), F.count_if(F.col("weight") == 1).alias("n_normal"), F.sum("weight").alias("total_weight"))


def oversample(samples: DataFrame, objects: DataFrame) -> DataFrame:
    """All originals, and selection_count named copies of the image of each selected object."""
    copies = objects.join(samples, "image_id").withColumn("rep", F.explode(F.expr("sequence(1, cast(selection_count AS int))")))
    name = F.format_string("%s__e4hm_rank%04d_rep%02d", "stem", "global_rank", "rep")
    return samples.select("image_id", "stem", F.lit("original").alias("kind")).unionByName(copies.select("image_id", name.alias("stem"), F.lit("copy").alias("kind")))


def compare_margins(a: DataFrame, b: DataFrame) -> DataFrame:
    """Margins of two experiments by case: delta, status (a lower margin is better), changed prediction."""
    x = a.select("case_id", F.col("margin").alias("margin_a"), F.col("pred_class").alias("pred_a"))
    y = b.select("case_id", F.col("margin").alias("margin_b"), F.col("pred_class").alias("pred_b"))
    both = x.join(y, "case_id").withColumn("delta", F.round(F.col("margin_b") - F.col("margin_a"), 4))
    status = F.when(F.col("delta") < 0, "improved").when(F.col("delta") > 0, "regressed").when(F.col("delta") == 0, "unchanged")
    return both.withColumn("status", status).withColumn("prediction_changed", F.col("pred_a") != F.col("pred_b"))


def margin_summary(cmp: DataFrame) -> DataFrame:
    """Of ``compare_margins``: matched cases, how many improved, regressed and stayed, and both mean margins with their difference, of four decimals."""
    status = lambda x: F.count_if(F.col("status") == x).alias(x)
    mean = lambda c: _ten_thousandths(F.col(c)) / F.count(c)
    a, b = mean("margin_a"), mean("margin_b")
    return cmp.agg(
        F.count("*").alias("matched_cases"), status("improved"), status("regressed"), status("unchanged"),
        (F.round(a) / 10000).alias("avg_margin_a"), (F.round(b) / 10000).alias("avg_margin_b"), (F.round(b - a) / 10000).alias("delta_margin"),
    )
