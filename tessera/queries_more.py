"""Further queries of the library and their SQL: geometry, audits, rankings, set operations and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import fixtures as fx
from tessera.functions import boxes as bx
from tessera.operators import bank, build, compare, errors, latency, matching, metrics, sampling, similarity
from tessera.queries import AP_SQL, BAL, BASE, CMP, CONF, ERR, KNN, M, M2, MINE, OVER, POOL, SEED, _apart, _both, _confusions, _draws, _matches, _pool, ap_sql, oversampled, query
from tessera.sources import files

# ---- geometry and rules ---------------------------------------------------------------------------------------------

NORM = "(x1 + x2) / 2 / 800 AS cx, (y1 + y2) / 2 / 600 AS cy, (x2 - x1) / 800 AS w, (y2 - y1) / 600 AS h"


@query(f"""WITH {BASE}, n AS (SELECT *, {NORM} FROM gt), p AS (SELECT *, cx * 800 - w * 800 / 2 AS a, cy * 600 - h * 600 / 2 AS b, cx * 800 + w * 800 / 2 AS c, cy * 600 + h * 600 / 2 AS d FROM n),
i AS (SELECT *, greatest(0, least(trunc(a)::BIGINT, 799)) AS ia, greatest(0, least(trunc(b)::BIGINT, 599)) AS ib FROM p)
SELECT image_id, gt_idx::BIGINT AS gt_idx, round(a, 6) AS fx1, round(b, 6) AS fy1, round(c, 6) AS fx2, round(d, 6) AS fy2, ia AS ix1, ib AS iy1, greatest(ia + 1, least(trunc(c)::BIGINT, 800)) AS ix2, greatest(ib + 1, least(trunc(d)::BIGINT, 600)) AS iy2 FROM i""")
def pixel_boxes(spark, d):
    g = fx.gt(spark, d).selectExpr("image_id", "gt_idx", *NORM.split(", "))
    names = ("x1", "y1", "x2", "y2")
    made = [(f"{k}{n}", v) for k, fn in (("f", bx.yolo_to_xyxy), ("i", bx.yolo_to_int_box)) for n, v in zip(names, fn("cx", "cy", "w", "h", 800, 600), strict=True)]
    return g.select("image_id", "gt_idx", *[v.alias(n) for n, v in made])


@query(f"""WITH {BASE}, k AS (SELECT image_id, gt_idx, greatest(0, least(trunc(x1 - 150)::BIGINT, 799)) AS a, greatest(0, least(trunc(y1 - 20)::BIGINT, 599)) AS b, greatest(0, least(trunc(x2 - 150)::BIGINT, 800)) AS c, greatest(0, least(trunc(y2 - 20)::BIGINT, 600)) AS d FROM gt)
SELECT image_id, gt_idx::BIGINT AS gt_idx, CASE WHEN c > a AND d > b THEN a END AS crop_x1, CASE WHEN c > a AND d > b THEN b END AS crop_y1, CASE WHEN c > a AND d > b THEN c END AS crop_x2, CASE WHEN c > a AND d > b THEN d END AS crop_y2 FROM k""")
def clipped_crops(spark, d):
    x1, y1, x2, y2 = bx.box_cols()
    crop = bx.clip_crop((x1 - 150, y1 - 20, x2 - 150, y2 - 20), 800, 600)
    return fx.gt(spark, d).select("image_id", "gt_idx", crop.alias("c")).select("image_id", "gt_idx", *[F.col(f"c.{n}").alias(f"crop_{n}") for n in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {BASE}, e AS (SELECT image_id, gt_idx, greatest(0, x1 - 120) AS a, greatest(0, y1 + 30) AS b, least(800, x2 + 1 - 120) AS c, least(600, y2 + 1 + 30) AS d FROM gt)
SELECT image_id, gt_idx::BIGINT AS gt_idx, round((a + c) / 2 / 800, 6) AS cx, round((b + d) / 2 / 600, 6) AS cy, round((c - a) / 800, 6) AS w, round((d - b) / 600, 6) AS h FROM e WHERE c > a AND d > b""")
def extents(spark, d):
    made = bx.extent_to_yolo("x1", "y1", "x2", "y2", -120, 30, 800, 600)
    return fx.gt(spark, d).select("image_id", "gt_idx", made.alias("e")).where("e IS NOT NULL").select("image_id", "gt_idx", "e.*")


@query(f"""WITH {BASE} SELECT image_id, pred_idx::BIGINT AS pred_idx, round(greatest(0, least((x1 - 0) / 1.25::DOUBLE, 512)), 6) AS ux1, round(greatest(0, least((y1 - 40) / 1.25::DOUBLE, 384)), 6) AS uy1,
  round(greatest(0, least((x2 - 0) / 1.25::DOUBLE, 512)), 6) AS ux2, round(greatest(0, least((y2 - 40) / 1.25::DOUBLE, 384)), 6) AS uy2 FROM pred""")
def unletterboxed(spark, d):
    x1, y1, x2, y2 = bx.box_cols()
    u = bx.unletterbox((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, 1.25, 0.0, 40.0, 512, 384)
    return fx.pred(spark, d).select("image_id", "pred_idx", *[v.alias(n) for v, n in zip(u, ("ux1", "uy1", "ux2", "uy2"), strict=True)])


@query(f"""WITH {BASE}, k AS (SELECT image_id, pred_idx, x1, y1, CASE WHEN (image_id + pred_idx) % 13 = 0 THEN x1 WHEN (image_id + pred_idx) % 17 = 0 THEN 'NaN'::DOUBLE ELSE x2 END AS x2, y2 FROM pred)
SELECT image_id, pred_idx::BIGINT AS pred_idx, isfinite(x2) AND x2 > x1 AND y2 > y1 AS strictly_valid, isfinite(x2) AND x2 >= x1 AND y2 >= y1 AS valid, isfinite(x2) AND x2 - x1 >= 50 AND y2 - y1 >= 50 AND (x2 - x1) / (y2 - y1) BETWEEN 0.5 AND 1.5 AS size_ok FROM k""")
def box_rules(spark, d):
    at = F.col("image_id") + F.col("pred_idx")
    p = fx.pred(spark, d).withColumn("x2", F.when(at % 13 == 0, F.col("x1")).when(at % 17 == 0, F.lit(float("nan"))).otherwise(F.col("x2")))
    w = F.when(~F.isnan("x2"), F.col("x2") - F.col("x1"))
    return p.select("image_id", "pred_idx", bx.box_valid(bx.box_cols(), True).alias("strictly_valid"), bx.box_valid(bx.box_cols(), False).alias("valid"), bx.size_ok(w, F.col("y2") - F.col("y1"), 50, 0.5, 1.5).alias("size_ok"))


@query(f"""WITH {BASE}, ll AS ({fx.LABEL_LINES}), t AS (SELECT image_id, line_no, string_split(line, ' ')[2] AS token FROM ll)
SELECT image_id, line_no::BIGINT AS line_no, try_cast(token AS DOUBLE) AS as_double, coalesce(trunc(try_cast(token AS DOUBLE))::BIGINT, -1) AS as_int FROM t""")
def parsed_tokens(spark, d):
    token = F.get(F.split("line", " "), F.lit(1))
    return fx.label_lines(spark, d).select("image_id", "line_no", bx.safe_double(token).alias("as_double"), bx.safe_int(token, -1).alias("as_int"))


@query("""SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND starts_with(lower(regexp_replace(replace(url, '\\', '/'), '/+', '/', 'g')), 'https:/')""")
def train_only(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 3 != 0, "train").otherwise("val").alias("split"))
    return bx.train_only(p, "https:").select("page_id")


# ---- reports and rankings --------------------------------------------------------------------------------------------


@query(f"{AP_SQL} SELECT class_id, round(ap, 6) AS ap FROM r WHERE threshold = 0.5 ORDER BY ap, class_id LIMIT 1")
def worst_class(spark, d):
    return errors.worst_class(metrics.metrics_of_images(fx.images(spark, d)))


@query(f"WITH RECURSIVE {BASE}, {ap_sql('r', ious=metrics.IOUS)} SELECT round(avg(ap) FILTER (threshold = 0.5), 6) AS map50, round(avg(ap) FILTER (threshold = 0.75), 6) AS map75, round(avg(ap), 6) AS map50_95 FROM r")
def mean_ap(spark, d):
    return metrics.mean_ap(metrics.metrics_of_images(fx.images(spark, d), metrics.IOUS))


@query(f"{M} SELECT pred_class AS class_id, count(*) AS count, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT image_id) AS n_images, count(*)::DOUBLE AS priority_score FROM m_all WHERE status = 'fp' GROUP BY 1 ORDER BY count DESC, class_id LIMIT 3")
def rank_false_positives(spark, d):
    return errors.rank(errors.false_positives(_matches(spark, d)), "count", ["class_id"], 3)


@query(f"{M} SELECT gt_class AS class_id, count(*) AS count, count(DISTINCT image_id) AS n_images, count(*)::DOUBLE AS priority_score FROM m_all WHERE status = 'fn' GROUP BY 1 ORDER BY count DESC, class_id LIMIT 3")
def rank_false_negatives(spark, d):
    return errors.rank(errors.false_negatives(_matches(spark, d)), "count", ["class_id"], 3)


@query(f"{ERR} SELECT source_class AS class_id, round((sum(count) / 3)::DOUBLE, 6) AS policy FROM e GROUP BY 1")
def policy_scores(spark, d):
    kinds = ("confusion", "false_negative", "false_positive")
    n = errors.error_table(_matches(spark, d)).groupBy(F.col("source_class").alias("class_id")).agg(*[F.sum(F.when(F.col("error_type") == k, F.col("count")).otherwise(0)).alias(k) for k in kinds])
    return n.select("class_id", errors.policy_score(*[F.col(k).cast("double") for k in kinds]).alias("policy"))


@query(f"WITH {BASE} SELECT image_id, pred_idx::BIGINT AS pred_idx, (x2 - x1) * (y2 - y1) AS area FROM pred ORDER BY area DESC, image_id, pred_idx LIMIT 20")
def largest_boxes(spark, d):
    p = fx.pred(spark, d).select("image_id", "pred_idx", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    return errors.top_by(p, "area", 20, ["image_id", "pred_idx"])


@query("SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, count(*) AS n_samples, 5::BIGINT AS n_classes FROM orders GROUP BY 1")
def dataset_metadata(spark, d):
    o = fx.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("val").alias("split"))
    return errors.dataset_metadata(o, 5)


@query(f"WITH {BASE} SELECT count(*) AS n_empty FROM orders WHERE o_orderkey NOT IN (SELECT image_id FROM gt WHERE class_id = 1)")
def empty_labels(spark, d):
    images = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return errors.empty_labels(images, fx.gt(spark, d).where("class_id = 1"))


@query(f"{M}, c AS ({CONF.format(t='m_all')}), k AS (SELECT gt_class, pred_class FROM c ORDER BY count DESC, gt_class, pred_class LIMIT 4) SELECT image_id, gt_idx, pred_idx, gt_class, pred_class, round(iou, 6) AS iou, round(confidence, 6) AS confidence FROM m_all JOIN k USING (gt_class, pred_class) WHERE status = 'match'")
def cases_of_top_pairs(spark, d):
    m = _matches(spark, d)
    top = errors.rank(errors.confusion(m), "count", ["gt_class", "pred_class"], 4).select("gt_class", "pred_class")
    return matching.attach_cases(top, errors.confusion_cases(m))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings), x AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS df, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]) / greatest(abs(z[1]), 1e-8)) AS re FROM v)
SELECT vec_id, true AS same_shape, round(list_max(df), 6) AS max_abs_diff, round(list_avg(df), 6) AS mean_abs_diff, round(list_avg(re), 2) AS mean_rel_error FROM x""")
def array_agreement(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    out = latency.array_agreement(e.withColumn("b", F.reverse("a"))).drop("a", "b")
    return out.withColumn("mean_rel_error", F.round("mean_rel_error", 2))


@query("SELECT count(*) AS n_images, round(sum(CAST(value AS DOUBLE)), 2) AS total_ms, round(avg(CAST(value AS DOUBLE)), 6) AS avg_ms, round(1000 * count(*) / sum(CAST(value AS DOUBLE)), 6) AS fps FROM events WHERE value > 0")
def scoring_summary(spark, d):
    s = latency.scoring_summary(fx.table(spark, d, "events").where("value > 0").select(F.col("value").cast("double").alias("inference_ms")))
    return s.withColumn("total_ms", F.round("total_ms", 2))


# ---- comparison ------------------------------------------------------------------------------------------------------

FPN = "fa AS (SELECT {c} AS class_id, count(*) AS count, avg(confidence) AS mean_confidence FROM m_all WHERE status = '{s}' GROUP BY 1), fb AS (SELECT {c} AS class_id, count(*) AS count, avg(confidence) AS mean_confidence FROM n_all WHERE status = '{s}' GROUP BY 1), j AS (SELECT class_id, coalesce(fa.count, 0) AS base_count, coalesce(fb.count, 0) AS exp_count, fa.mean_confidence AS base_mean_confidence, fb.mean_confidence AS exp_mean_confidence FROM fa FULL JOIN fb USING (class_id))"
CHANGE = "base_count, exp_count, exp_count - base_count AS delta, CASE WHEN base_count > 0 THEN round((exp_count - base_count) / base_count, 6) END AS relative_change, CASE WHEN exp_count > base_count THEN 'regressed' WHEN exp_count < base_count THEN 'improved' ELSE 'unchanged' END AS status"


@query(f"{M2}, {FPN.format(c='gt_class', s='fn')} SELECT class_id, {CHANGE} FROM j")
def compare_false_negatives(spark, d):
    return compare.compare_error_class(*_apart(errors.false_negatives(_both(spark, d), ["experiment"]).drop("n_images")))


@query(f"{M2}, {FPN.format(c='pred_class', s='fp')} SELECT sum(base_count)::BIGINT AS base_total, sum(exp_count)::BIGINT AS exp_total FROM j")
def false_positive_totals(spark, d):
    return compare.error_totals(compare.compare_error_class(*_apart(errors.false_positives(_both(spark, d), ["experiment"]).drop("n_images"))))


@query(f"{CMP} SELECT gt_class, pred_class, exp_count - base_count AS delta FROM cj WHERE exp_count > base_count ORDER BY delta DESC, gt_class, pred_class LIMIT 5")
def top_regressions(spark, d):
    cmp = compare.compare_confusions(*_confusions(spark, d))
    return compare.top_changes(cmp, ties=["gt_class", "pred_class"]).select("gt_class", "pred_class", "delta")


def _outcomes(spark, d):
    """The outcomes of all classes in either experiment: several reports read them, the matches are made once."""
    return _apart(errors.outcomes(_both(spark, d), by=["experiment"]))


PR = """SELECT coalesce(p.class_id, g.class_id) AS class_id, "precision", recall FROM (SELECT pred_class AS class_id, count(*) FILTER (status = 'match' AND gt_class = pred_class) / count(*) AS "precision" FROM {t} WHERE pred_class IS NOT NULL GROUP BY 1) p FULL JOIN (SELECT gt_class AS class_id, count(*) FILTER (status = 'match' AND gt_class = pred_class) / count(*) AS recall FROM {t} WHERE gt_class IS NOT NULL GROUP BY 1) g USING (class_id)"""
PRS = f"ra AS ({PR.format(t='m_all')}), rb AS ({PR.format(t='n_all')})"


@query(f"""{M2}, {PRS} SELECT class_id, round(ra."precision", 6) AS base_precision, round(rb."precision", 6) AS exp_precision, round(ra.recall, 6) AS base_recall, round(rb.recall, 6) AS exp_recall, round(rb."precision" - ra."precision", 6) + 0.0 AS precision_delta, round(rb.recall - ra.recall, 6) + 0.0 AS recall_delta FROM ra FULL JOIN rb USING (class_id)""")
def compare_metrics(spark, d):
    return compare.compare_metrics(*map(errors.rates, _outcomes(spark, d)), ("precision", "recall"))


def _deltas(m: str) -> str:
    return f"SELECT '{m}' AS metric, class_id, y.{m} - x.{m} AS delta FROM x JOIN y USING (class_id)".replace(".precision", '."precision"')


@query(f"""WITH RECURSIVE {BASE}, {ap_sql('x', ious=(0.5,))}, {ap_sql('y', 'pred2', (0.5,))}, u AS ({" UNION ALL ".join(map(_deltas, ("recall", "ap", "precision")))})
SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY delta, class_id) AS place, class_id, round(delta, 6) + 0.0 AS delta FROM u QUALIFY place <= 3""")
def worst_metric_changes(spark, d):
    m = metrics.metrics_of_images(fx.images(spark, d), preds=("preds", "preds2"))
    a, b = (m.where(F.col("experiment") == n) for n in ("preds", "preds2"))
    return compare.worst_deltas(compare.compare_metrics(a, b), k=3)


@query(f"""{CMP}, {PRS}, {FPN.format(c='pred_class', s='fp')}, {FPN.format(c='gt_class', s='fn').replace('fa ', 'ga ').replace('fb ', 'gb ').replace('fa.', 'ga.').replace('fb.', 'gb.').replace('FROM fa', 'FROM ga').replace('JOIN fb', 'JOIN gb').replace('j AS', 'gj AS')},
st AS (SELECT count(*) FILTER (iou >= 0.8) / count(*) AS bh, count(*) FILTER (iou < 0.5) / count(*) AS bl FROM m_all WHERE status = 'match' AND gt_class <> pred_class), su AS (SELECT count(*) FILTER (iou >= 0.8) / count(*) AS eh, count(*) FILTER (iou < 0.5) / count(*) AS el FROM n_all WHERE status = 'match' AND gt_class <> pred_class), tt AS (SELECT sum(exp_count) - sum(base_count) AS t FROM cj)
SELECT 'recall_regression' AS signal, round(ra.recall - rb.recall, 6) AS value, NULL::BIGINT AS gt_class, NULL::BIGINT AS pred_class FROM ra JOIN rb USING (class_id) WHERE class_id = 2 AND rb.recall < ra.recall
UNION ALL SELECT 'classification_dominant_regression', round(eh, 6), NULL, NULL FROM st, su, tt WHERE t > 0 AND eh >= bh UNION ALL SELECT 'localization_regression_signal', round(el, 6), NULL, NULL FROM st, su WHERE el > bl
UNION ALL SELECT * FROM (SELECT 'dominant_confusion', (exp_count - base_count)::DOUBLE, gt_class, pred_class FROM cj WHERE exp_count > base_count ORDER BY exp_count - base_count DESC, gt_class, pred_class LIMIT 1)
UNION ALL SELECT 'false_positive_increase', (exp_count - base_count)::DOUBLE, NULL, NULL FROM j WHERE class_id = 2 AND exp_count > base_count UNION ALL SELECT 'false_negative_increase', (exp_count - base_count)::DOUBLE, NULL, NULL FROM gj WHERE class_id = 2 AND exp_count > base_count""")
def diagnosis(spark, d):
    a, b = _outcomes(spark, d)
    wrong = [o.where("status = 'match' AND gt_class <> pred_class") for o in (a, b)]
    share = lambda c: F.when(F.sum("n_iou") > 0, F.sum(c) / F.sum("n_iou")).alias(f"{c}_ratio")
    stats = [w.agg(share("high_iou"), share("low_iou")) for w in wrong]
    no_means = [w.withColumns({"mean_iou": F.lit(None).cast("double"), "mean_confidence": F.lit(None).cast("double")}) for w in wrong]  # no signal reads them
    rates = compare.compare_metrics(errors.rates(a), errors.rates(b), ("precision", "recall"))
    of_class = lambda status, c: compare.compare_error_class(*[o.where(F.col("status") == status).select(F.col(c).alias("class_id"), "count") for o in (a, b)])
    return compare.diagnose(rates, compare.compare_confusions(*no_means), *stats, of_class("fp", "pred_class"), of_class("fn", "gt_class"), 2)


@query(f"{M2}, a AS (SELECT DISTINCT status, image_id FROM m_all), b AS (SELECT DISTINCT status, image_id FROM n_all) SELECT status, image_id, CASE WHEN b.k IS NULL THEN 'base_only' WHEN a.k IS NULL THEN 'exp_only' ELSE 'both' END AS side FROM (SELECT *, 1 AS k FROM a) a FULL JOIN (SELECT *, 1 AS k FROM b) b USING (status, image_id)")
def error_image_list(spark, d):
    return compare.error_image_list(_both(spark, d))


# ---- set operations --------------------------------------------------------------------------------------------------

SETS = "SELECT o_orderkey AS image_id FROM orders WHERE {c}"


@query(f"WITH a AS ({SETS.format(c='o_orderkey % 2 = 0')}), b AS ({SETS.format(c='o_orderkey % 3 = 0')}) SELECT 'both' AS side, image_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a', image_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b', image_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def image_set_diff(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    both, a, b = compare.image_set_diff(o.where("image_id % 2 = 0"), o.where("image_id % 3 = 0"))
    tag = lambda n, df: df.select(F.lit(n).alias("side"), "image_id")
    return tag("both", both).unionByName(tag("a", a)).unionByName(tag("b", b))


NAMES = "x AS (SELECT concat('f', c_custkey) AS name, c_custkey AS k FROM customer)"


@query(f"WITH {NAMES} SELECT name, 'missing' AS problem FROM x WHERE k % 7 = 0 AND k % 5 <> 0 UNION ALL SELECT name, 'unexpected' FROM x WHERE k % 7 <> 0 AND k % 5 = 0")
def name_diff(spark, d):
    x = fx.table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("k"))
    return compare.name_diff(x.where("k % 7 = 0"), x.where("k % 5 = 0"))


@query(f"WITH {NAMES} SELECT name, CASE WHEN k % 4 = 0 THEN 'first' ELSE 'second' END AS source FROM x WHERE k % 4 = 0 OR k % 6 = 0")
def merged_samples(spark, d):
    x = fx.table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("k"))
    part = lambda by, n: x.where(f"k % {by} = 0").select("name", F.lit(n).alias("source"))
    return compare.merge_samples(part(4, "first"), part(6, "second"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice::DOUBLE, 6) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def first_by_key(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    return compare.first_by_key(o, ["o_custkey"], ["price", "o_orderkey"])


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) SELECT k AS o_custkey, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual FROM a FULL JOIN b USING (k) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def count_mismatch(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return matching.count_mismatch(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 <> 0"), "o_custkey")


# ---- similarity and mining ---------------------------------------------------------------------------------------------


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def next_similarity(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(after, "vec_id").select("vec_id", similarity.cosine(F.col("v"), F.col("w")).alias("similarity"))


def _patterns(cases):
    n = cases.groupBy("gt_class", "pred_class").agg(F.count("*").alias("n"))
    ranked = n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "gt_class", "pred_class"))).where("r <= 10")
    return ranked.select(F.concat_ws("_", F.lit("confusion"), F.col("gt_class").cast("string"), F.lit("to"), F.col("pred_class").cast("string")).alias("pattern_id"), F.lit("confusion").alias("error_type"), F.col("gt_class").alias("source_class"), F.col("pred_class").alias("target_class"))


PATTERNS = "pt AS (SELECT concat_ws('_', 'confusion', gt_class::VARCHAR, 'to', pred_class::VARCHAR) AS pattern_id, gt_class, pred_class FROM q GROUP BY gt_class, pred_class QUALIFY row_number() OVER (ORDER BY count(*) DESC, gt_class, pred_class) <= 10)"


@query(f"{KNN}, {PATTERNS}, cp AS (SELECT pattern_id, case_id, q.gt_class, q.pred_class FROM q JOIN pt USING (gt_class, pred_class)) SELECT * FROM (SELECT pattern_id, case_id, class_id::BIGINT AS class_id, object_id, similarity, row_number() OVER (PARTITION BY pattern_id, case_id ORDER BY similarity DESC, object_id) AS rank FROM cp JOIN knn USING (case_id) WHERE class_id IN (gt_class, pred_class)) WHERE rank <= 5")
def mine_pattern(spark, d):
    index, cases = fx.embeddings(spark, d)
    patterns = _patterns(cases)
    mine = cases.join(patterns.select("pattern_id", F.col("source_class").alias("gt_class"), F.col("target_class").alias("pred_class")), ["gt_class", "pred_class"])
    return similarity.mine_pattern(patterns, mine, index, 5, other_than_self=True)


@query(f"{KNN}, {PATTERNS} SELECT pattern_id, object_id, class_id::BIGINT AS class_id FROM ix JOIN (SELECT pattern_id, unnest([gt_class, pred_class]) AS class_id FROM pt) USING (class_id)")
def pattern_candidates(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.pattern_candidates(_patterns(cases), index).select("pattern_id", "object_id", "class_id")


@query(f"{MINE} SELECT class_id::BIGINT AS class_id, selection_count, count(*) AS n_objects, sum(selection_count)::BIGINT AS n_copies FROM mo GROUP BY ALL")
def mining_stats(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.mining_stats(similarity.mine_objects(cases, index, 5, other_than_self=True))


@query(f"{MINE} SELECT count(*) AS n_images, count(object_id) AS n_hard, count(*) - count(object_id) AS n_normal, (count(*) + 2 * count(object_id))::DOUBLE AS total_weight FROM embeddings LEFT JOIN mo ON object_id = vec_id")
def weight_stats(spark, d):
    index, cases = fx.embeddings(spark, d)
    hard = similarity.mine_objects(cases, index, 5, other_than_self=True).select(F.col("object_id").alias("image_id"))
    return similarity.weight_stats(similarity.image_weights(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id")), hard))


@query("SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 4 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight FROM orders")
def attached_weights(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return matching.attach_weights(o, o.where("image_id % 4 = 0").withColumn("weight", F.lit(3.0)))


@query(f"""{M} SELECT image_id, gt_idx, array_to_string(list_filter([CASE WHEN gt_idx = 3 THEN 'missing_iou' END, CASE WHEN image_id % 9 = 0 THEN 'missing_confidence' END, CASE WHEN gt_class <> 1 THEN 'wrong_gt_class' END, CASE WHEN pred_class <> 2 THEN 'wrong_pred_class' END], lambda x: x IS NOT NULL), ',') AS problems
FROM m_all WHERE status = 'match' AND gt_class <> pred_class""")
def case_checks(spark, d):
    c = errors.confusion_cases(_matches(spark, d)).withColumns({
        "image_path": F.col("image_id").cast("string"), "gt_bbox": F.array(F.lit(0.0)), "pred_bbox": F.array(F.lit(0.0)), "iou": F.when(F.col("gt_idx") != 3, F.col("iou")), "confidence": F.when(F.col("image_id") % 9 != 0, F.col("confidence")),
    })
    return similarity.check_cases(c, 1, 2).select("image_id", "gt_idx", F.concat_ws(",", "problems").alias("problems"))


MINED = """s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat('train/', p_partkey % 700) END AS image_path, CASE WHEN p_partkey % 31 = 0 THEN [1.0, 2.0, 3.0]::DOUBLE[] WHEN p_partkey % 29 = 0 THEN [5.0, 5.0, 5.0, 9.0]::DOUBLE[] ELSE [1.0, 2.0, 3.0 + p_partkey % 3, 9.0]::DOUBLE[] END AS bbox,
  (p_size / 40.0)::DOUBLE AS similarity, p_partkey % 4 AS matched, p_partkey % 37 <> 0 AS in_train, p_partkey % 10 AS confusion_rank, p_partkey AS position FROM part),
e AS (SELECT *, CASE WHEN image_path IS NULL THEN ['missing_keys'] ELSE list_filter([CASE WHEN NOT in_train THEN 'not_train_sample' WHEN (k % 700) % 23 = 0 THEN 'image_not_found' END, CASE WHEN len(bbox) <> 4 THEN 'invalid_bbox_length' WHEN bbox[3] <= bbox[1] OR bbox[4] <= bbox[2] THEN 'invalid_bbox' END,
  CASE WHEN similarity > 1 THEN 'invalid_similarity' END, CASE WHEN matched < 1 THEN 'invalid_matched_test_cases' END], lambda x: x IS NOT NULL) END AS errors FROM s),
g AS (SELECT *, len(errors) = 0 AND row_number() OVER (PARTITION BY len(errors) = 0, image_path, bbox ORDER BY confusion_rank, position) = 1 AS keep FROM e)"""


def _mined(spark, d):
    p = fx.table(spark, d, "part").selectExpr(
        "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat('train/', p_partkey % 700) END AS image_path",
        "CASE WHEN p_partkey % 31 = 0 THEN array(1D, 2D, 3D) WHEN p_partkey % 29 = 0 THEN array(5D, 5D, 5D, 9D) ELSE array(1D, 2D, 3D + p_partkey % 3, 9D) END AS bbox",
        "'metal' AS class_name", "CAST(p_size / 40D AS DOUBLE) AS similarity", "p_partkey % 4 AS matched_test_cases", "p_partkey % 37 <> 0 AS in_train", "p_partkey % 10 AS confusion_rank", "p_partkey AS position",
    )
    images = p.where("image_path IS NOT NULL AND CAST(substr(image_path, 7) AS INT) % 23 <> 0").select("image_path").distinct()
    return similarity.audit_mined(p, images)


@query(f"WITH {MINED} SELECT position, array_to_string(errors, ',') AS errors, keep FROM g")
def mined_audit(spark, d):
    return _mined(spark, d).select("position", F.concat_ws(",", "errors").alias("errors"), "keep")


@query(f"WITH {MINED} SELECT count(*) AS total_samples, count(*) FILTER (keep) AS valid_samples, count(*) FILTER (len(errors) > 0) AS invalid_samples, count(*) FILTER (len(errors) = 0 AND NOT keep) AS duplicate_samples FROM g")
def mined_statistics(spark, d):
    return similarity.audit_statistics(_mined(spark, d))


# ---- banks, samples, plans ----------------------------------------------------------------------------------------------

FACTS = "SELECT concat('img', c_custkey, CASE WHEN c_custkey % 19 = 0 THEN '.gif' ELSE '.jpg' END) AS path, CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 0 ELSE 400 + c_custkey * 37 % 900 END AS width, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 300 + c_custkey * 53 % 700 END AS height, CAST(c_custkey * 7 % 400 AS DOUBLE) AS laplacian, CAST(c_custkey * 11 % 256 AS DOUBLE) AS brightness, CAST(c_custkey * 3 % 80 AS DOUBLE) AS contrast FROM customer"
BANK = f"""f AS ({FACTS}), q AS (SELECT *, 0.5 * greatest(0, least(1, laplacian / 500)) + 0.25 * greatest(0, least(1, 1 - abs(brightness - 127.5) / 127.5)) + 0.25 * greatest(0, least(1, contrast / 64)) AS score FROM f),
v AS (SELECT path, score, CASE WHEN path NOT LIKE '%.jpg' THEN ['unsupported_extension'] WHEN width IS NULL THEN ['image_unreadable'] WHEN width <= 0 THEN ['invalid_dimensions'] ELSE list_filter([CASE WHEN width < 640 THEN 'width_too_small' END, CASE WHEN height < 480 THEN 'height_too_small' END,
  CASE WHEN width / height < 0.5 THEN 'aspect_ratio_too_small' END, CASE WHEN width / height > 2.5 THEN 'aspect_ratio_too_large' END, CASE WHEN laplacian < 50 THEN 'image_blurry' END, CASE WHEN brightness < 35 THEN 'image_too_dark' END, CASE WHEN brightness > 220 THEN 'image_too_bright' END,
  CASE WHEN contrast < 25 THEN 'low_contrast' END, CASE WHEN score < 0.25 THEN 'quality_score_too_low' END], lambda x: x IS NOT NULL) END AS reasons FROM q)"""


def _bank(spark, d):
    fx.table(spark, d, "customer").createOrReplaceTempView("customer")
    return bank.validate_images(bank.image_quality(spark.sql(FACTS)))


@query(f"WITH {BANK} SELECT path, round(score, 6) AS quality_score, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS usable FROM v")
def bank_validation(spark, d):
    return _bank(spark, d).select("path", "quality_score", F.concat_ws(",", "reasons").alias("reasons"), "usable")


@query(f"WITH {BANK} SELECT count(*) AS total, count(*) FILTER (len(reasons) = 0) AS approved, count(*) FILTER (len(reasons) > 0) AS rejected, round(count(*) FILTER (len(reasons) = 0) / count(*), 6) AS approval_rate FROM v")
def bank_summary(spark, d):
    return bank.bank_summary(_bank(spark, d))


@query(f"WITH {POOL}, {BAL} SELECT class_name, sum(CASE WHEN bucket = 'small' THEN n ELSE 0 END)::BIGINT AS small, sum(CASE WHEN bucket = 'medium' THEN n ELSE 0 END)::BIGINT AS medium, sum(CASE WHEN bucket = 'large' THEN n ELSE 0 END)::BIGINT AS large, sum(n)::BIGINT AS draws FROM (SELECT p.object_id, p.class_name, p.bucket, count(b.draw) AS n FROM pool p LEFT JOIN b USING (object_id) GROUP BY ALL) GROUP BY 1")
def coverage_by_class_area(spark, d):
    return sampling.coverage_by_class_area(_pool(spark, d), sampling.balanced_sample(_pool(spark, d), _draws(spark, d), SEED))


@query(f"WITH {POOL}, {BAL} SELECT generations, count(*) AS draws, sum(generations)::BIGINT AS synthetic_images FROM b GROUP BY 1")
def coverage_by_generations(spark, d):
    return sampling.coverage_by_generations(sampling.balanced_sample(_pool(spark, d), _draws(spark, d), SEED))


SHUFFLED = f"SELECT c_custkey AS image_id, row_number() OVER (ORDER BY md5(concat('{SEED}:', c_custkey)), c_custkey) AS r, count(*) OVER () AS n FROM customer"


@query(f"SELECT image_id FROM ({SHUFFLED}) WHERE r <= floor(n * 0.3)")
def take_fraction(spark, d):
    return sampling.take_fraction(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id")), 0.3, SEED)


@query(f"SELECT image_id FROM ({SHUFFLED}) WHERE r <= 200")
def subset_sample(spark, d):
    return sampling.subset(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id")), 200, SEED)


@query(f"WITH bg AS ({fx.BACKGROUNDS}) SELECT row_number() OVER (ORDER BY cycle, md5(concat('{SEED}:', cycle, ':', background_id)), background_id) - 1 AS draw, background_id, category FROM bg, (SELECT unnest(range(0, 2)) AS cycle) QUALIFY draw < (SELECT count(*) FROM bg) * 3 // 2")
def sample_backgrounds(spark, d):
    b = fx.backgrounds(spark, d)
    return sampling.sample_backgrounds(b, b.count() * 3 // 2, SEED, "background_id")


META = """SELECT p_partkey AS k, CASE WHEN p_partkey % 53 = 0 THEN '' ELSE concat('o', p_partkey) END AS object_id, CASE WHEN p_partkey % 47 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN p_partkey % 43 = 0 THEN -1 ELSE p_partkey % 5 END AS class_id, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 'metal' END AS class_name,
  CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE 640 END AS image_width, 480 AS image_height, p_partkey % 600 AS x1, 10 AS y1, p_partkey % 600 + 60 AS x2, CASE WHEN p_partkey % 31 = 0 THEN 10 ELSE 50 END AS y2, CASE WHEN p_partkey % 29 = 0 THEN 61 ELSE 60 END AS crop_width, 40 AS crop_height,
  CAST(p_size AS DOUBLE) / CAST(49 AS DOUBLE) AS segmentation_score, p_size % 10 AS mask_area, 2400 AS bbox_area, CAST(p_size % 10 AS DOUBLE) / CAST(8 AS DOUBLE) AS occupancy FROM part"""


@query(f"""WITH m AS ({META}) SELECT k, array_to_string(list_filter([CASE WHEN object_id = '' THEN 'empty_object_id' END, CASE WHEN split <> 'train' THEN 'not_train_split' END, CASE WHEN class_id < 0 THEN 'negative_class_id' END, CASE WHEN class_name IS NULL THEN 'empty_class_name' END, CASE WHEN image_width <= 0 THEN 'invalid_image_dimensions' END,
  CASE WHEN x2 > image_width THEN 'bbox_outside_image' END, CASE WHEN y2 <= y1 THEN 'invalid_bbox_dimensions' END, CASE WHEN crop_width <> 60 OR crop_height <> y2 - y1 THEN 'crop_size_mismatch' END, CASE WHEN segmentation_score > 1 THEN 'segmentation_score_out_of_range' END, CASE WHEN mask_area <= 0 THEN 'empty_mask' END,
  CASE WHEN occupancy > 1 THEN 'occupancy_out_of_range' END], lambda x: x IS NOT NULL), ',') AS problems FROM m""")
def metadata_audit(spark, d):
    fx.table(spark, d, "part").createOrReplaceTempView("part")
    return build.check_metadata(spark.sql(META)).select("k", F.concat_ws(",", "problems").alias("problems"))


@query("SELECT p_partkey AS object_id, concat('o/', p_partkey) AS object_path FROM part WHERE p_partkey % 6 <> 0")
def object_pool(spark, d):
    m = fx.table(spark, d, "part").select(F.col("p_partkey").alias("object_id"), F.concat(F.lit("o/"), F.col("p_partkey").cast("string")).alias("object_path"))
    return build.object_pool(m, m.where("object_id % 6 <> 0").select(F.col("object_path").alias("path")))


KINDS = "SELECT concat('i', o_orderkey) AS name, concat('s', o_custkey) AS source, CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'synthetic' ELSE 'original' END AS kind FROM orders"


@query(f"SELECT count(DISTINCT source) AS source_images, count(*) FILTER (kind = 'original') AS original_images, count(*) FILTER (kind = 'synthetic') AS synthetic_images, count(*) FILTER (kind = 'failed') AS failures FROM ({KINDS})")
def build_summary(spark, d):
    fx.table(spark, d, "orders").createOrReplaceTempView("orders")
    return build.build_summary(spark.sql(KINDS))


@query(f"WITH k AS ({KINDS}), p AS (SELECT count(*) AS listed, count(*) FILTER (kind = 'synthetic') AS n_listed FROM k WHERE right(name, 1) <> '7'), s AS (SELECT (SELECT count(*) FROM k) AS images, (SELECT count(*) FROM k WHERE kind = 'synthetic') AS n, (SELECT count(*) FROM k WHERE kind = 'original') AS o, listed, n_listed FROM p) SELECT images = images AS images_equal_labels, images = o + n AS images_equal_parts, n = n AS synthetic_equal_objects, listed = images AS samples_equal_images, n_listed = n AS samples_equal_synthetic FROM s")
def reconcile(spark, d):
    fx.table(spark, d, "orders").createOrReplaceTempView("orders")
    k = spark.sql(KINDS)
    n = k.agg(F.count("*").alias("images"), F.count("*").alias("labels"), F.count_if(F.col("kind") == "original").alias("originals"), F.count_if(F.col("kind") == "synthetic").alias("synthetic"), F.count_if(F.col("kind") == "synthetic").alias("objects"))
    return build.reconcile(n, k.where("right(name, 1) <> '7'"))  # some samples are not listed


@query(f"WITH k AS ({KINDS}) SELECT name, source, kind FROM k WHERE (kind = 'original' OR kind = 'synthetic') AND right(name, 1) <> '3'")
def finalised(spark, d):
    fx.table(spark, d, "orders").createOrReplaceTempView("orders")
    k = spark.sql(KINDS)
    return build.finalise(k.where("kind = 'original'"), k.where("kind <> 'failed'"), k.where("right(name, 1) <> '3'").select("name"))


@query(f"WITH {OVER} SELECT count(*) FILTER (kind = 'original') AS originals, count(*) FILTER (kind = 'copy') AS copies, count(*) AS samples, count(*) FILTER (kind = 'original') + count(*) FILTER (kind = 'copy') = count(*) AS adds_up FROM ou")
def oversample_totals(spark, d):
    return build.oversample_totals(oversampled(spark, d)[1])


@query(f"WITH {OVER} SELECT copies, count(*) AS sources FROM (SELECT source_stem, count(*) AS copies FROM ou WHERE kind = 'copy' GROUP BY 1) GROUP BY 1")
def copy_frequency(spark, d):
    return build.copy_frequency(oversampled(spark, d)[1])


@query(f"WITH {OVER}, c AS (SELECT stem AS source_stem, k % 5 AS class_id FROM src) SELECT class_id, count(*) AS copies, count(DISTINCT source_stem) AS sources FROM ou JOIN c USING (source_stem) WHERE kind = 'copy' GROUP BY 1")
def copy_classes(spark, d):
    source, out, _ = oversampled(spark, d)
    return build.copy_classes(out, source.select(F.col("stem").alias("source_stem"), (F.substring("stem", 2, 20).cast("bigint") % 5).alias("class_id")))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE c_mktsegment END AS category, count(*) AS n FROM customer GROUP BY 1")
def manifest_categories(spark, d):
    c = fx.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("category"))
    return files.manifest_categories(c)


PLACES = "SELECT CASE WHEN c_custkey % 11 = 0 THEN 'no label here' ELSE concat('/', lower(substr(c_mktsegment, 1, 1)), '/', lower(c_mktsegment), '/in/', c_custkey, '.jpg ', c_nationkey) END AS value, c_mktsegment, c_custkey, c_nationkey FROM customer"


@query(f"SELECT concat(lower(substr(c_mktsegment, 1, 1)), '/', lower(c_mktsegment), '/in/', c_custkey, '.jpg') AS path, concat(lower(c_mktsegment), '/in') AS category, c_nationkey::BIGINT AS label FROM ({PLACES}) WHERE c_custkey % 11 <> 0")
def place_lines(spark, d):
    fx.table(spark, d, "customer").createOrReplaceTempView("customer")
    return files.parse_place_lines(spark.sql(PLACES).select("value"))


@query("WITH p AS (SELECT concat('raw/', lower(c_mktsegment), '/f', c_custkey, '.JPG') AS path, lower(c_mktsegment) AS class_name, concat('f', c_custkey, '.JPG') AS file FROM customer) SELECT path, class_name, file, concat('img_', printf('%06d', row_number() OVER (ORDER BY class_name, file, path)), '.jpg') AS new_name FROM p")
def class_folders(spark, d):
    c = fx.table(spark, d, "customer").select(F.concat(F.lit("raw/"), F.lower("c_mktsegment"), F.lit("/f"), F.col("c_custkey").cast("string"), F.lit(".JPG")).alias("path"))
    return files.ingest_class_folders(c)
