"""The library's queries over the driver's tables, and the same in SQL.

Integers leave as BIGINT and doubles rounded to six decimals, on both sides, so that values compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import fixtures as fx
from tessera.functions import boxes as bx
from tessera.operators import bank, build, compare, errors, index, latency, matching, metrics, sampling, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 42


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), 6) + 0.0).alias(f.name))  # no negative zero
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- shared SQL -------------------------------------------------------------------------------------------------

BASE = f"gt AS MATERIALIZED ({fx.GT}), pred AS MATERIALIZED ({fx.PRED}), pred2 AS MATERIALIZED ({fx.PRED2}), classes AS ({fx.CLASSES})"


def iou_sql(a: str, b: str) -> str:
    inter = f"(greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"


def greedy_sql(name: str, candidates: str, keys: str, order: str) -> str:
    """CTEs that fold the candidate pairs (columns l and r) of each group; ``name`` has the pairs that are taken."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"f.{x} = c.{x}" for x in k)
    ck = ", ".join(f"c.{x}" for x in k)
    busy = "list_contains(f.ls, c.l) OR list_contains(f.rs, c.r)"
    return f"""{name}_c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({candidates})),
{name}_f AS (SELECT DISTINCT {keys}, 0::BIGINT AS rn, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM {name}_c
  UNION ALL SELECT {ck}, c.rn, CASE WHEN {busy} THEN f.ls ELSE list_append(f.ls, c.l) END, CASE WHEN {busy} THEN f.rs ELSE list_append(f.rs, c.r) END
  FROM {name}_f f JOIN {name}_c c ON {on} AND c.rn = f.rn + 1),
{name}_l AS (SELECT {keys}, max_by(ls, rn) AS ls, max_by(rs, rn) AS rs FROM {name}_f GROUP BY {keys}),
{name}_p AS (SELECT {keys}, unnest(ls) AS l, unnest(rs) AS r FROM {name}_l),
{name} AS MATERIALIZED (SELECT c.* FROM {name}_c c JOIN {name}_p p ON {' AND '.join(f'c.{x} = p.{x}' for x in k)} AND c.l = p.l AND c.r = p.r)"""


def match_sql(name: str, preds: str = "pred", order: str = "-conf, l, -iou, r") -> str:
    cand = f"SELECT p.image_id, p.pred_idx::BIGINT AS l, g.gt_idx::BIGINT AS r, p.class_id AS pred_class, g.class_id AS gt_class, p.confidence AS conf, {iou_sql('p', 'g')} AS iou, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2 FROM {preds} p JOIN gt g USING (image_id) WHERE {iou_sql('p', 'g')} >= 0.5"
    return greedy_sql(name, cand, "image_id", order) + f""",
{name}_all AS MATERIALIZED (SELECT image_id, l AS pred_idx, r AS gt_idx, pred_class, gt_class, conf AS confidence, iou, 'match' AS status FROM {name}
  UNION ALL SELECT p.image_id, p.pred_idx::BIGINT, NULL, p.class_id, NULL, p.confidence, NULL, 'fp' FROM {preds} p WHERE NOT EXISTS (SELECT 1 FROM {name} m WHERE m.image_id = p.image_id AND m.l = p.pred_idx)
  UNION ALL SELECT g.image_id, NULL, g.gt_idx::BIGINT, NULL, g.class_id, NULL, NULL, 'fn' FROM gt g WHERE NOT EXISTS (SELECT 1 FROM {name} m WHERE m.image_id = g.image_id AND m.r = g.gt_idx))"""


M = f"WITH RECURSIVE {BASE}, {match_sql('m')}"
M2 = f"{M}, {match_sql('n', 'pred2')}"
ALL = "image_id, pred_idx, gt_idx, pred_class, gt_class, round(confidence, 6) AS confidence, round(iou, 6) AS iou, status"
CONF = "SELECT gt_class, pred_class, count(*) AS count, avg(iou) AS mean_iou, avg(confidence) AS mean_confidence, count(DISTINCT image_id) AS n_images FROM {t} WHERE status = 'match' AND gt_class <> pred_class GROUP BY ALL"
R6 = "round({0}, 6) + 0.0 AS {0}"
CONF_OUT = "gt_class, pred_class, count, round(mean_iou, 6) AS mean_iou, round(mean_confidence, 6) AS mean_confidence, n_images"


def _matches(spark: SparkSession, d: str, second: bool = False) -> DataFrame:
    return matching.match_images(fx.images(spark, d), preds="preds2" if second else "preds")


def _both(spark: SparkSession, d: str) -> DataFrame:
    """The matches of both experiments, in one pass over the boxes."""
    return matching.match_experiments(fx.images(spark, d))


def _apart(counts: DataFrame) -> list[DataFrame]:
    """The counts of either experiment, a few rows, as tables: the matches of both are made once."""
    kept = bank.cut(counts)
    return [kept.where(F.col("experiment") == n).drop("experiment") for n in ("preds", "preds2")]


def _confusions(spark: SparkSession, d: str) -> list[DataFrame]:
    return _apart(errors.confusion(_both(spark, d), ["experiment"]).drop("n_images"))


# ---- matching and error reports ----------------------------------------------------------------------------------


@query(f"{M} SELECT {ALL} FROM m_all")
def match_detections(spark, d):
    return _matches(spark, d)


@query(f"WITH RECURSIVE {BASE}, {match_sql('m', order='l, -iou, r')} SELECT {ALL} FROM m_all")
def match_input_order(spark, d):
    return matching.match_images(fx.images(spark, d), order="input")


AWARE = greedy_sql("a", f"SELECT p.image_id, p.class_id, p.pred_idx::BIGINT AS l, q.pred_idx::BIGINT AS r, p.confidence AS a_conf, q.confidence AS b_conf, {iou_sql('p', 'q')} AS iou FROM pred p JOIN pred2 q ON p.image_id = q.image_id AND p.class_id = q.class_id WHERE {iou_sql('p', 'q')} >= 0.5", "image_id, class_id", "l, -iou, r")


@query(f"WITH RECURSIVE {BASE}, {AWARE} SELECT image_id, class_id, l AS a_idx, r AS b_idx, round(a_conf, 6) AS a_conf, round(b_conf, 6) AS b_conf, round(iou, 6) AS iou FROM a")
def match_class_aware(spark, d):
    return matching.match_predictions(fx.pred(spark, d), fx.pred2(spark, d))


@query(f"""WITH RECURSIVE {BASE}, {AWARE}, i AS (SELECT DISTINCT o_orderkey AS image_id FROM orders), na AS (SELECT image_id, count(*) AS n FROM pred GROUP BY 1), nb AS (SELECT image_id, count(*) AS n FROM pred2 GROUP BY 1),
k AS (SELECT image_id, count(*) AS n, avg(iou) AS u, avg(abs(a_conf - b_conf)) AS c FROM a GROUP BY 1),
j AS (SELECT coalesce(na.n, 0) AS x, coalesce(nb.n, 0) AS y, coalesce(k.n, 0) AS m, u, c FROM i LEFT JOIN na USING (image_id) LEFT JOIN nb USING (image_id) LEFT JOIN k USING (image_id))
SELECT count(*) AS n_images, count(*) FILTER (x = m AND y = m) AS exact_images, count(*) FILTER (m > 0 AND u >= 0.999 AND c <= 1e-5) AS near_perfect_images,
  round(count(*) FILTER (x = m AND y = m) / count(*), 6) AS exact_rate, round(count(*) FILTER (m > 0 AND u >= 0.999 AND c <= 1e-5) / count(*), 6) AS near_perfect_rate,
  sum(x)::BIGINT AS total_a, sum(y)::BIGINT AS total_b, (sum(y) - sum(x))::BIGINT AS count_difference, sum(m)::BIGINT AS total_matches, sum(x - m)::BIGINT AS unmatched_a, sum(y - m)::BIGINT AS unmatched_b,
  round(sum(m) / (sum(x) + sum(y) - sum(m)), 6) AS match_rate, round(avg(u), 6) AS avg_iou, round(min(u), 6) AS min_iou, round(avg(c), 6) AS avg_conf_diff, round(max(c), 6) AS max_conf_diff FROM j""")
def agreement_summary(spark, d):
    a, b = fx.pred(spark, d), fx.pred2(spark, d)
    images = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    return latency.agreement_summary(matching.match_predictions(a, b), a, b, images)


@query(f"{M}, c AS ({CONF.format(t='m_all')}) SELECT {CONF_OUT} FROM c")
def confusion(spark, d):
    return errors.confusion(_matches(spark, d))


@query(f"{M}, c AS ({CONF.format(t='m_all')}) SELECT {CONF_OUT}, count::DOUBLE AS priority_score FROM c ORDER BY count DESC, gt_class, pred_class LIMIT 10")
def confusion_ranking(spark, d):
    return errors.rank(errors.confusion(_matches(spark, d)), "count", ["gt_class", "pred_class"], 10)


@query(f"{M} SELECT pred_class AS class_id, count(*) AS count, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT image_id) AS n_images FROM m_all WHERE status = 'fp' GROUP BY 1")
def false_positives(spark, d):
    return errors.false_positives(_matches(spark, d))


@query(f"{M} SELECT gt_class AS class_id, count(*) AS count, count(DISTINCT image_id) AS n_images FROM m_all WHERE status = 'fn' GROUP BY 1")
def false_negatives(spark, d):
    return errors.false_negatives(_matches(spark, d))


@query(f"{M} SELECT class_id::BIGINT AS gt_class, " + ", ".join(f"count(*) FILTER (pred_class = {k}) AS pred_{k}" for k in range(5)) + " FROM classes LEFT JOIN (SELECT * FROM m_all WHERE status = 'match' AND gt_class <> pred_class) ON gt_class = class_id GROUP BY 1")
def confusion_matrix(spark, d):
    return errors.confusion_matrix(_matches(spark, d), range(5))


ERR = f"{M}, e AS (SELECT 'confusion' AS error_type, gt_class AS source_class, pred_class AS target_class, count(*) AS count FROM m_all WHERE status = 'match' AND gt_class <> pred_class GROUP BY ALL UNION ALL SELECT 'false_negative', gt_class, NULL, count(*) FROM m_all WHERE status = 'fn' GROUP BY ALL UNION ALL SELECT 'false_positive', pred_class, NULL, count(*) FROM m_all WHERE status = 'fp' GROUP BY ALL)"


@query(f"""{ERR}, s AS (SELECT *, concat_ws('_', error_type, source_class::VARCHAR, CASE WHEN target_class IS NOT NULL THEN 'to' END, target_class::VARCHAR) AS pattern_id, (CASE WHEN error_type = 'false_positive' THEN count ELSE 2 * count END)::BIGINT AS score FROM e WHERE count >= 2)
SELECT error_type, source_class, target_class, count, pattern_id, score, row_number() OVER (ORDER BY score DESC, count DESC, pattern_id) AS pattern_rank FROM s""")
def failure_patterns(spark, d):
    return errors.find_patterns(errors.error_table(_matches(spark, d)))


@query(f"{ERR} SELECT source_class AS class_id, sum(CASE WHEN error_type = 'false_positive' THEN count ELSE 2 * count END)::BIGINT AS priority FROM e WHERE count >= 2 GROUP BY 1")
def class_priority(spark, d):
    return errors.class_priority(errors.find_patterns(errors.error_table(_matches(spark, d))))


@query(f"{ERR} SELECT error_type, source_class, target_class, count, count::DOUBLE AS priority FROM e WHERE count >= 5 ORDER BY priority DESC, error_type, source_class, target_class NULLS FIRST LIMIT 12")
def top_patterns(spark, d):
    return errors.extract_patterns(errors.error_table(_matches(spark, d)), 5, 12)


@query(f"{M} SELECT * FROM (SELECT image_id, gt_idx, pred_idx, gt_class, pred_class, round(iou, 6) AS iou, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY gt_class, pred_class ORDER BY image_id, gt_idx) AS case_no FROM m_all WHERE status = 'match' AND gt_class <> pred_class) WHERE case_no <= 3")
def first_error_cases(spark, d):
    return errors.first_cases(errors.confusion_cases(_matches(spark, d)), 3, ["gt_class", "pred_class"], ["image_id", "gt_idx"])


@query(f"{M} SELECT gt_class, pred_class, count(*) AS n_cases, round(avg(iou), 6) AS mean_iou, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (iou >= 0.8) AS high_iou, count(*) FILTER (iou < 0.5) AS low_iou, round(count(*) FILTER (iou >= 0.8) / count(iou), 6) AS high_iou_ratio, round(count(*) FILTER (iou < 0.5) / count(iou), 6) AS low_iou_ratio FROM m_all WHERE status = 'match' AND gt_class <> pred_class GROUP BY ALL")
def case_statistics(spark, d):
    return compare.case_statistics(errors.confusion_cases(_matches(spark, d)), ["gt_class", "pred_class"])


def ap_sql(name: str, preds: str = "pred", ious: tuple[float, ...] = (0.5, 0.75)) -> str:
    """CTEs ending in ``name``: threshold, class_id, n_gt, n_pred, tp, precision, recall, ap of a table of predictions."""
    ts = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in ious) + ") t(threshold)"
    n = name
    matched = greedy_sql(f"{n}_a", f"SELECT t.threshold, p.image_id, p.class_id, p.pred_idx::BIGINT AS l, g.gt_idx::BIGINT AS r, p.confidence AS conf, {iou_sql('p', 'g')} AS iou FROM {preds} p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id JOIN {ts} ON {iou_sql('p', 'g')} >= t.threshold", "threshold, image_id, class_id", "-conf, l, -iou, r")
    return f"""{matched}, {n}_ts AS (SELECT * FROM {ts}),
{n}_st AS (SELECT threshold, class_id, confidence, count(*) AS n FROM {preds}, {n}_ts GROUP BY ALL), {n}_hit AS (SELECT threshold, class_id, conf AS confidence, count(*) AS tp FROM {n}_a GROUP BY ALL),
{n}_cu AS (SELECT threshold, class_id, confidence, coalesce(tp, 0) AS tp, sum(n) OVER w AS seen, sum(coalesce(tp, 0)) OVER w AS found FROM {n}_st LEFT JOIN {n}_hit USING (threshold, class_id, confidence) WINDOW w AS (PARTITION BY threshold, class_id ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)),
{n}_en AS (SELECT *, max(found / seen) OVER (PARTITION BY threshold, class_id ORDER BY confidence DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM {n}_cu),
{n}_g AS (SELECT class_id, count(*) AS n_gt FROM gt GROUP BY 1),
{n}_x AS (SELECT e.threshold, e.class_id, max(seen) AS n_pred, max(found) AS tp, sum(p * e.tp / n_gt) AS ap FROM {n}_en e JOIN {n}_g USING (class_id) GROUP BY ALL),
{n} AS (SELECT t.threshold, g.class_id, n_gt, coalesce(n_pred, 0)::BIGINT AS n_pred, coalesce(tp, 0)::BIGINT AS tp, CASE WHEN coalesce(n_pred, 0) > 0 THEN tp / n_pred ELSE 0 END AS "precision", coalesce(tp, 0) / n_gt AS recall, coalesce(ap, 0) AS ap FROM {n}_g g CROSS JOIN {n}_ts t LEFT JOIN {n}_x x ON x.threshold = t.threshold AND x.class_id = g.class_id)"""


AP_SQL = f"WITH RECURSIVE {BASE}, {ap_sql('r')}"
_SCORES = 'round("precision", 6) AS "precision", round(recall, 6) AS recall, round(ap, 6) AS ap'


@query(f"{AP_SQL} SELECT threshold, class_id, n_gt, n_pred, tp, {_SCORES} FROM r")
def detection_ap(spark, d):
    return metrics.metrics_of_images(fx.images(spark, d), (0.5, 0.75))


@query(f"""{AP_SQL} SELECT class_id, {_SCORES}, round(ap, 6) AS priority_score, CASE WHEN ap > 0.9 THEN 'good' WHEN ap > 0.8 THEN 'medium' ELSE 'poor' END AS level,
  CASE WHEN ap >= 0.85 THEN 'Performance is good, no specific recommendation' WHEN recall < 0.8 THEN 'Add more training samples for this class' WHEN "precision" < 0.8 THEN 'Reduce false positives by adjusting confidence threshold' ELSE 'Consider data augmentation specific to this class' END AS advice FROM r WHERE threshold = 0.5""")
def rank_classes(spark, d):
    m = metrics.metrics_of_images(fx.images(spark, d)).select("class_id", "precision", "recall", "ap")
    return errors.rank(m, "ap", ["class_id"]).withColumns({"level": bx.performance_level("ap"), "advice": bx.recommendation("ap", "precision", "recall")})


NMS = f"""p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pred_idx) AS rn FROM pred),
k AS (SELECT DISTINCT image_id, 0::BIGINT AS rn, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS b, []::BIGINT[] AS ids FROM p UNION ALL
  SELECT p.image_id, p.rn, CASE WHEN hit THEN b ELSE list_append(b, {{'x1': p.x1, 'y1': p.y1, 'x2': p.x2, 'y2': p.y2}}) END, CASE WHEN hit THEN ids ELSE list_append(ids, p.pred_idx::BIGINT) END
  FROM (SELECT k.b, k.ids, p.*, len(list_filter(k.b, lambda m: {iou_sql('m', 'p')} > 0.45)) > 0 AS hit FROM k JOIN p ON k.image_id = p.image_id AND p.rn = k.rn + 1) p),
kept AS (SELECT image_id, unnest(ids) AS pred_idx FROM (SELECT image_id, max_by(ids, rn) AS ids FROM k GROUP BY 1))"""


@query(f"WITH RECURSIVE {BASE}, {NMS} SELECT image_id, pred_idx, class_id, round(confidence, 6) AS confidence, x1, y1, x2, y2 FROM kept JOIN (SELECT image_id, pred_idx::BIGINT AS pred_idx, class_id, confidence, x1, y1, x2, y2 FROM pred) USING (image_id, pred_idx)")
def nms(spark, d):
    return matching.nms(fx.pred(spark, d))


@query(f"WITH {BASE} SELECT image_id, pred_idx::BIGINT AS pred_idx, class_name, round(confidence, 6) AS confidence FROM pred JOIN classes USING (class_id) WHERE confidence >= CASE class_id WHEN 1 THEN 0.7 WHEN 3 THEN 0.3 ELSE 0.5 END")
def confidence_filter(spark, d):
    kept = bx.filter_confidence(fx.pred(spark, d), 0.5, {1: 0.7, 3: 0.3})
    return bx.with_class_name(kept, fx.classes(spark)).select("image_id", "pred_idx", "class_name", "confidence")


@query(f"""WITH {BASE} SELECT image_id, pred_idx::BIGINT AS pred_idx, floor((x2 - x1) * (y2 - y1) / 48 + 0.5) / 10000 AS area_ratio, floor((x2 - x1) * 12.5 + 0.5) / 10000 AS width_ratio, floor((y2 - y1) * 100 / 6 + 0.5) / 10000 AS height_ratio, x1 <= 1 OR y1 <= 1 OR x2 >= 799 OR y2 >= 599 AS touches_border,
  concat(image_id::VARCHAR, '|', printf('%.4f,%.4f,%.4f,%.4f', x1, y1, x2, y2)) AS object_key FROM pred""")
def box_diagnostics(spark, d):
    df = bx.box_diagnostics(fx.pred(spark, d).withColumn("width", F.lit(800)).withColumn("height", F.lit(600)))
    return df.withColumn("object_key", bx.object_key(F.col("image_id").cast("string"), bx.box_cols())).select("image_id", "pred_idx", "area_ratio", "width_ratio", "height_ratio", "touches_border", "object_key")


@query(f"WITH {BASE} SELECT class_id::BIGINT AS class_id, class_name, count(image_id) AS n_objects, round(100.0 * count(image_id) / (SELECT count(*) FROM gt), 4) AS percentage FROM classes LEFT JOIN gt USING (class_id) GROUP BY ALL")
def object_distribution(spark, d):
    return errors.object_distribution(fx.gt(spark, d), fx.classes(spark))


# ---- comparison of two experiments --------------------------------------------------------------------------------

STATUS = "CASE WHEN base_count = 0 AND exp_count > 0 THEN 'new_error' WHEN base_count > 0 AND exp_count = 0 THEN 'removed_error' WHEN exp_count < base_count THEN 'improved' WHEN exp_count > base_count THEN 'regressed' ELSE 'unchanged' END AS status"
COUNTS = f"base_count, exp_count, exp_count - base_count AS delta, CASE WHEN base_count > 0 THEN round((exp_count - base_count) / base_count, 6) END AS relative_change, {STATUS}"
CMP = f"{M2}, ca AS ({CONF.format(t='m_all')}), cb AS ({CONF.format(t='n_all')}), cj AS (SELECT gt_class, pred_class, coalesce(ca.count, 0) AS base_count, ca.mean_iou AS base_mean_iou, ca.mean_confidence AS base_mean_confidence, coalesce(cb.count, 0) AS exp_count, cb.mean_iou AS exp_mean_iou, cb.mean_confidence AS exp_mean_confidence FROM ca FULL JOIN cb USING (gt_class, pred_class))"


@query(f"{CMP} SELECT gt_class, pred_class, round(base_mean_iou, 6) AS base_mean_iou, round(exp_mean_iou, 6) AS exp_mean_iou, round(base_mean_confidence, 6) AS base_mean_confidence, round(exp_mean_confidence, 6) AS exp_mean_confidence, {COUNTS}, CASE WHEN exp_mean_iou IS NULL THEN 'unknown' WHEN exp_mean_iou >= 0.8 THEN 'classification_dominant' WHEN exp_mean_iou < 0.5 THEN 'localization_dominant' ELSE 'mixed' END AS kind FROM cj")
def compare_confusions(spark, d):
    return compare.compare_confusions(*_confusions(spark, d))


@query(f"""{M2}, fa AS (SELECT pred_class AS class_id, count(*) AS count, avg(confidence) AS c FROM m_all WHERE status = 'fp' GROUP BY 1), fb AS (SELECT pred_class AS class_id, count(*) AS count, avg(confidence) AS c FROM n_all WHERE status = 'fp' GROUP BY 1),
j AS (SELECT class_id, coalesce(fa.count, 0) AS base_count, coalesce(fb.count, 0) AS exp_count, round(fa.c, 6) AS base_mean_confidence, round(fb.c, 6) AS exp_mean_confidence FROM fa FULL JOIN fb USING (class_id))
SELECT class_id, base_mean_confidence, exp_mean_confidence, base_count, exp_count, exp_count - base_count AS delta, CASE WHEN base_count > 0 THEN round((exp_count - base_count) / base_count, 6) END AS relative_change, CASE WHEN exp_count > base_count THEN 'regressed' WHEN exp_count < base_count THEN 'improved' ELSE 'unchanged' END AS status FROM j""")
def compare_false_positives(spark, d):
    return compare.compare_error_class(*_apart(errors.false_positives(_both(spark, d), ["experiment"]).drop("n_images")))


@query(f"""{CMP}, s AS (SELECT 'base' AS e, gt_class AS class_id, 'outgoing' AS direction, base_count AS n FROM cj UNION ALL SELECT 'base', pred_class, 'incoming', base_count FROM cj UNION ALL SELECT 'exp', gt_class, 'outgoing', exp_count FROM cj UNION ALL SELECT 'exp', pred_class, 'incoming', exp_count FROM cj)
SELECT class_id, direction, sum(n) FILTER (e = 'base')::BIGINT AS base_total, sum(n) FILTER (e = 'exp')::BIGINT AS exp_total, (sum(n) FILTER (e = 'exp') - sum(n) FILTER (e = 'base'))::BIGINT AS delta FROM s WHERE class_id IN (1, 4) GROUP BY ALL""")
def focus_classes(spark, d):
    return compare.focus_classes(*_confusions(spark, d), [1, 4])


@query(f"{M2}, a AS (SELECT DISTINCT status, image_id FROM m_all), b AS (SELECT DISTINCT status, image_id FROM n_all) SELECT coalesce(a.status, b.status) AS status, count(*) FILTER (a.image_id IS NOT NULL AND b.image_id IS NOT NULL) AS both, count(*) FILTER (b.image_id IS NULL) AS base_only, count(*) FILTER (a.image_id IS NULL) AS exp_only FROM a FULL JOIN b ON a.status = b.status AND a.image_id = b.image_id GROUP BY 1")
def error_images(spark, d):
    return compare.error_image_sets(_both(spark, d))


def _boxed(spark: SparkSession, d: str, second: bool) -> DataFrame:
    """The matches with the predictions' boxes."""
    return matching.match_images(fx.images(spark, d), boxes=True, preds="preds2" if second else "preds")


def _cases(spark: SparkSession, d: str, second: bool) -> DataFrame:
    wrong = _boxed(spark, d, second).where("status = 'match' AND gt_class <> pred_class")
    return wrong.select("image_id", "gt_class", "pred_class", "iou", "confidence", "x1", "y1", "x2", "y2", F.col("pred_idx").alias("case_idx"))


CASES = "SELECT image_id, l AS case_idx, gt_class, pred_class, iou, conf AS confidence, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2 FROM {t} WHERE gt_class <> pred_class"
TRANS = greedy_sql("t", f"SELECT p.image_id, p.gt_class, p.case_idx AS l, q.case_idx AS r, p.pred_class AS base_pred, q.pred_class AS exp_pred, q.iou - p.iou AS iou_delta, q.confidence - p.confidence AS confidence_delta, {iou_sql('p', 'q')} AS score FROM xa p JOIN xb q ON p.image_id = q.image_id AND p.gt_class = q.gt_class WHERE {iou_sql('p', 'q')} >= 0.95", "image_id, gt_class", "-score, l, r")


@query(f"""{M2}, xa AS MATERIALIZED ({CASES.format(t='m')}), xb AS MATERIALIZED ({CASES.format(t='n')}), {TRANS}
SELECT image_id, gt_class, l AS base_idx, r AS exp_idx, base_pred, exp_pred, round(iou_delta, 6) + 0.0 AS iou_delta, round(confidence_delta, 6) + 0.0 AS confidence_delta, CASE WHEN base_pred = exp_pred THEN 'persistent_error' ELSE 'prediction_changed' END AS transition FROM t
UNION ALL SELECT image_id, gt_class, case_idx, NULL, pred_class, NULL, NULL, NULL, 'confusion_resolved_or_changed' FROM xa WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = xa.image_id AND t.l = xa.case_idx)
UNION ALL SELECT image_id, gt_class, NULL, case_idx, NULL, pred_class, NULL, NULL, 'new_confusion_case' FROM xb WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = xb.image_id AND t.r = xb.case_idx)""")
def case_transitions(spark, d):
    return compare.case_transitions(_cases(spark, d, False), _cases(spark, d, True))


def _fp_cases(spark: SparkSession, d: str, second: bool) -> DataFrame:
    fp = _boxed(spark, d, second).where("status = 'fp'")
    return fp.select("image_id", F.col("pred_class").alias("class_id"), F.col("pred_idx").alias("case_idx"), "iou", "confidence", "x1", "y1", "x2", "y2")


FPC = "SELECT p.image_id, p.class_id, p.pred_idx::BIGINT AS case_idx, p.x1, p.y1, p.x2, p.y2 FROM {p} p JOIN {m}_all m ON m.image_id = p.image_id AND m.pred_idx = p.pred_idx WHERE m.status = 'fp'"
PERS = greedy_sql("t", f"SELECT p.image_id, p.class_id, p.case_idx AS l, q.case_idx AS r, {iou_sql('p', 'q')} AS score FROM xa p JOIN xb q ON p.image_id = q.image_id AND p.class_id = q.class_id WHERE {iou_sql('p', 'q')} >= 0.95", "image_id, class_id", "-score, l, r")


@query(f"""{M2}, xa AS MATERIALIZED ({FPC.format(p='pred', m='m')}), xb AS MATERIALIZED ({FPC.format(p='pred2', m='n')}), {PERS}, k AS (SELECT class_id, count(*) AS persistent FROM t GROUP BY 1),
a AS (SELECT class_id, count(*) AS base_cases FROM xa GROUP BY 1), b AS (SELECT class_id, count(*) AS exp_cases FROM xb GROUP BY 1)
SELECT class_id, coalesce(base_cases, 0) AS base_cases, coalesce(exp_cases, 0) AS exp_cases, coalesce(persistent, 0) AS persistent, coalesce(base_cases, 0) - coalesce(persistent, 0) AS resolved, coalesce(exp_cases, 0) - coalesce(persistent, 0) AS new FROM a FULL JOIN b USING (class_id) LEFT JOIN k USING (class_id)""")
def false_positive_persistence(spark, d):
    return compare.case_persistence(_fp_cases(spark, d, False), _fp_cases(spark, d, True))


@query(f"""{M2}, a AS (SELECT image_id, gt_class, pred_class, count(*) AS c FROM m_all WHERE status = 'match' AND gt_class <> pred_class GROUP BY ALL), b AS (SELECT image_id, gt_class, pred_class, count(*) AS c FROM n_all WHERE status = 'match' AND gt_class <> pred_class GROUP BY ALL)
SELECT image_id, gt_class, pred_class, coalesce(a.c, 0) AS base_count, coalesce(b.c, 0) AS exp_count, CASE WHEN b.c IS NULL THEN 'improved' WHEN a.c IS NULL THEN 'regressed' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (image_id, gt_class, pred_class)""")
def diff_cases(spark, d):
    return matching.diff_cases(errors.confusion_cases(_matches(spark, d)), errors.confusion_cases(_matches(spark, d, True)))


# ---- similarity and hard mining -----------------------------------------------------------------------------------

E = """ix AS MATERIALIZED (SELECT vec_id AS object_id, label AS class_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS MATERIALIZED (SELECT vec_id AS case_id, label AS gt_class, (label + 1 + vec_id % 9) % 10 AS pred_class, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0)"""
KNN = f"WITH {E}, s AS (SELECT case_id, class_id, object_id, round(list_cosine_similarity(q.v, ix.v), 4) AS similarity FROM q JOIN ix ON object_id <> case_id), knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, class_id ORDER BY similarity DESC, object_id) AS rank FROM s) WHERE rank <= 5)"
MARG = f"{KNN}, mj AS (SELECT q.case_id, gt_class, pred_class, max(similarity) FILTER (class_id = gt_class) AS gt_best, max(similarity) FILTER (class_id = pred_class) AS pred_best FROM q LEFT JOIN knn USING (case_id) GROUP BY ALL), mg AS (SELECT *, CASE WHEN gt_class <> pred_class THEN round(pred_best - gt_best, 4) + 0.0 END AS margin FROM mj), mr AS (SELECT *, CASE WHEN margin > 0 THEN pred_class WHEN margin IS NOT NULL THEN gt_class END AS nearest_class FROM mg)"
MINE = f"{KNN}, mo AS (SELECT object_id, class_id, count(*) AS selection_count, max(similarity) AS max_similarity FROM knn JOIN q USING (case_id) WHERE class_id = gt_class GROUP BY ALL)"


@query(f"{KNN} SELECT case_id, class_id::BIGINT AS class_id, object_id, similarity, rank FROM knn")
def knn_per_class(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.knn(cases, index, 5, other_than_self=True)


def _index(spark: SparkSession, d: str) -> str:
    """The embeddings as an index in the shared folder."""
    path = f"{bank.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.write_index(fx.embeddings(spark, d)[0], path, 512)
    return path


@query(f"{KNN} SELECT case_id, class_id::BIGINT AS class_id, object_id, similarity, rank FROM knn")
def indexed_knn(spark, d):
    return index.search_index(fx.embeddings(spark, d)[1], _index(spark, d), 5, other_than_self=True)


@query(f"{KNN} SELECT case_id, class_id::BIGINT AS class_id, object_id, similarity, rank FROM knn WHERE class_id IN (2, 7)")
def indexed_knn_of_classes(spark, d):
    return index.search_index(fx.embeddings(spark, d)[1], _index(spark, d), 5, [2, 7], other_than_self=True)


@query(f"{MARG} SELECT case_id, gt_class::BIGINT AS gt_class, pred_class::BIGINT AS pred_class, gt_best, pred_best, margin, nearest_class::BIGINT AS nearest_class FROM mr")
def margins(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.margins(cases, similarity.knn(cases, index, 5, other_than_self=True))


@query(f"""{MARG}, r AS (SELECT 'pair' AS level, gt_class, pred_class, nearest_class, margin FROM mr UNION ALL SELECT 'overall', NULL, NULL, nearest_class, margin FROM mr),
c AS (SELECT *, (SELECT count(*) FROM mr x WHERE x.nearest_class = x.pred_class) AS allp, (SELECT count(*) FROM mr x WHERE x.nearest_class = x.gt_class) AS allg FROM r),
g AS (SELECT level, gt_class, pred_class, count(*) AS n_cases, count(margin) AS n_margins, sum(round(margin * 10000)) AS s, min(margin) AS lo, max(margin) AS hi,
  CASE WHEN level = 'pair' THEN count(*) FILTER (nearest_class = pred_class) ELSE min(allp) END AS nearest_pred, CASE WHEN level = 'pair' THEN count(*) FILTER (nearest_class = gt_class) ELSE min(allg) END AS nearest_gt FROM c GROUP BY level, gt_class, pred_class)
SELECT level, gt_class::BIGINT AS gt_class, pred_class::BIGINT AS pred_class, n_cases, n_margins, nearest_pred, nearest_gt, round(100 * nearest_pred / n_cases, 4) AS nearest_pred_pct, round(100 * nearest_gt / n_cases, 4) AS nearest_gt_pct,
  coalesce(round(s / n_margins) / 10000 + 0.0, 0) AS avg_margin, round(lo, 4) + 0.0 AS min_margin, round(hi, 4) + 0.0 AS max_margin,
  CASE WHEN s > 500 * n_margins THEN 'closer_to_predicted' WHEN s < -500 * n_margins THEN 'closer_to_true' ELSE 'ambiguous' END AS verdict FROM g""")
def similarity_report(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.similarity_report(similarity.margins(cases, similarity.knn(cases, index, 5, other_than_self=True)))


@query(f"{MARG} SELECT nearest_class::BIGINT AS nearest_class, count(*) AS n_cases, round(100 * count(*) / (SELECT count(*) FROM mr), 4) AS percentage FROM mr WHERE nearest_class IS NOT NULL GROUP BY 1")
def nearest_classes(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.nearest_classes(similarity.margins(cases, similarity.knn(cases, index, 5, other_than_self=True)))


@query(f"{MINE} SELECT object_id, class_id::BIGINT AS class_id, selection_count, max_similarity, row_number() OVER (ORDER BY selection_count DESC, max_similarity DESC, object_id) AS global_rank FROM mo")
def mine_objects(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.mine_objects(cases, index, 5, other_than_self=True).drop("selected_by")


@query(f"{MINE}, sc AS (SELECT *, round(selection_count * max_similarity, 6) AS score FROM mo) SELECT object_id, class_id::BIGINT AS class_id, selection_count, max_similarity, score, row_number() OVER (ORDER BY score DESC, selection_count DESC, max_similarity DESC, object_id) AS global_rank FROM sc")
def hard_manifest(spark, d):
    index, cases = fx.embeddings(spark, d)
    return similarity.hard_manifest(similarity.mine_objects(cases, index, 5, other_than_self=True).drop("selected_by"))


@query(f"""{KNN}, rk AS (SELECT gt_class, pred_class, row_number() OVER (ORDER BY count(*) DESC, gt_class, pred_class) AS confusion_rank FROM q GROUP BY gt_class, pred_class QUALIFY confusion_rank <= 10),
c AS (SELECT confusion_rank, q.gt_class, q.pred_class, object_id, max(similarity) AS max_similarity, count(*) AS matched_cases FROM knn JOIN q USING (case_id) JOIN rk ON rk.gt_class = q.gt_class AND rk.pred_class = q.pred_class WHERE class_id = q.gt_class GROUP BY ALL)
SELECT confusion_rank, gt_class::BIGINT AS gt_class, pred_class::BIGINT AS pred_class, object_id, max_similarity, matched_cases, row_number() OVER (PARTITION BY confusion_rank ORDER BY max_similarity DESC, matched_cases DESC, object_id) AS object_rank FROM c QUALIFY object_rank <= 8""")
def mine_confusions(spark, d):
    index, cases = fx.embeddings(spark, d)
    n = cases.groupBy("gt_class", "pred_class").agg(F.count("*").alias("n"))
    ranked = n.withColumn("confusion_rank", F.row_number().over(Window.orderBy(F.desc("n"), "gt_class", "pred_class"))).where("confusion_rank <= 10")
    return similarity.mine_confusions(ranked, cases, index, 5, 8, other_than_self=True)


@query(f"{MINE} SELECT vec_id AS image_id, CASE WHEN object_id IS NULL THEN 1.0 ELSE 3.0 END::DOUBLE AS weight FROM embeddings LEFT JOIN mo ON object_id = vec_id")
def image_weights(spark, d):
    index, cases = fx.embeddings(spark, d)
    hard = similarity.mine_objects(cases, index, 5, other_than_self=True).select(F.col("object_id").alias("image_id"))
    return similarity.image_weights(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id")), hard)


@query(f"""{MINE}, r AS (SELECT *, row_number() OVER (ORDER BY selection_count DESC, max_similarity DESC, object_id) AS g FROM mo)
SELECT vec_id AS image_id, concat('img', vec_id) AS stem, 'original' AS kind FROM embeddings UNION ALL
SELECT object_id, concat('img', object_id, '__e4hm_rank', printf('%04d', g), '_rep', printf('%02d', i)), 'copy' FROM (SELECT object_id, g, unnest(range(1, selection_count + 1)) AS i FROM r)""")
def oversample(spark, d):
    index, cases = fx.embeddings(spark, d)
    samples = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("img"), F.col("vec_id").cast("string")).alias("stem"))
    objects = similarity.mine_objects(cases, index, 5, other_than_self=True).select(F.col("object_id").alias("image_id"), "selection_count", "global_rank")
    return similarity.oversample(samples, objects)


@query(f"{MARG}, zero AS (SELECT case_id, pred_class, round(coalesce(pred_best, 0) - coalesce(gt_best, 0), 4) AS margin FROM mj), p AS (SELECT mr.case_id, mr.margin AS margin_a, mr.pred_class AS pred_a, zero.margin AS margin_b, zero.pred_class AS pred_b, round(zero.margin - mr.margin, 4) + 0.0 AS delta FROM mr JOIN zero USING (case_id)) SELECT case_id, margin_a, pred_a::BIGINT AS pred_a, margin_b, pred_b::BIGINT AS pred_b, delta, CASE WHEN delta < 0 THEN 'improved' WHEN delta > 0 THEN 'regressed' WHEN delta = 0 THEN 'unchanged' END AS status, pred_a <> pred_b AS prediction_changed FROM p")
def compare_margins(spark, d):
    index, cases = fx.embeddings(spark, d)
    near = similarity.knn(cases, index, 5, other_than_self=True)
    return similarity.compare_margins(similarity.margins(cases, near), similarity.margins(cases, near, "zero"))


@query(f"""{MARG}, zero AS (SELECT case_id, round(coalesce(pred_best, 0) - coalesce(gt_best, 0), 4) AS b FROM mj), p AS (SELECT mr.margin AS a, b, round(b - mr.margin, 4) AS delta FROM mr JOIN zero USING (case_id))
SELECT count(*) AS matched_cases, count(*) FILTER (delta < 0) AS improved, count(*) FILTER (delta > 0) AS regressed, count(*) FILTER (delta = 0) AS unchanged, round(sum(round(a * 10000)) / count(a)) / 10000 + 0.0 AS avg_margin_a, round(sum(round(b * 10000)) / count(b)) / 10000 + 0.0 AS avg_margin_b,
  round(sum(round(b * 10000)) / count(b) - sum(round(a * 10000)) / count(a)) / 10000 + 0.0 AS delta_margin FROM p""")
def margin_comparison_summary(spark, d):
    index, cases = fx.embeddings(spark, d)
    near = similarity.knn(cases, index, 5, other_than_self=True)
    return similarity.margin_summary(similarity.compare_margins(similarity.margins(cases, near), similarity.margins(cases, near, "zero")))


# ---- banks and duplicates -----------------------------------------------------------------------------------------


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """The sign pattern of each vector against its median, as 64 bits."""
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("path"), F.sort_array("embedding").alias("s"), "embedding")
    median = ((F.get("s", F.lit(31)).cast("double") + F.get("s", F.lit(32)).cast("double")) / 2).alias("m")
    bits = F.concat_ws("", F.transform("embedding", lambda x: F.when(x.cast("double") > F.col("m"), "1").otherwise("0")))
    part = lambda a: F.conv(F.substring("bits", a, 32), 2, 10).cast("bigint")
    return e.select("path", "embedding", median).select("path", bits.alias("bits")).select("path", F.shiftleft(part(1), 32).bitwiseOR(part(33)).alias("perceptual_hash"), F.lit(True).alias("usable"))


HASH = """h AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 THEN 1 ELSE 0 END) AS b FROM embeddings),
np AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.b[i] <> b.b[i] THEN 1 ELSE 0 END))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id)"""


@query(f"WITH {HASH}, f AS (SELECT b, min(vec_id) AS first FROM h GROUP BY b) SELECT a, np.b, distance FROM np JOIN f fa ON fa.first = a JOIN f fb ON fb.first = np.b WHERE distance BETWEEN 1 AND 8 UNION ALL SELECT first, vec_id, 0 FROM h JOIN f USING (b) WHERE vec_id <> first")
def near_duplicates(spark, d):
    return bank.near_pairs(_hashes(spark, d))


@query(f"""WITH RECURSIVE {HASH}, nb AS (SELECT b, list(a) AS before FROM np WHERE distance <= 8 GROUP BY b), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM h),
st AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS acc UNION ALL SELECT o.rn, CASE WHEN nb.before IS NOT NULL AND list_has_any(st.acc, nb.before) THEN st.acc ELSE list_append(st.acc, o.vec_id) END FROM st JOIN o ON o.rn = st.rn + 1 LEFT JOIN nb ON nb.b = o.vec_id),
l AS (SELECT acc FROM st ORDER BY rn DESC LIMIT 1) SELECT vec_id AS id, list_contains((SELECT acc FROM l), vec_id) AS accepted FROM h""")
def accept_in_order(spark, d):
    return bank.accept_in_order(_hashes(spark, d))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_path, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    files = fx.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return bank.exact_duplicates(bank.content_hash(files))


# ---- sampling -----------------------------------------------------------------------------------------------------

POOL = f"pool AS MATERIALIZED (SELECT *, CASE WHEN area_ratio < 0.05 THEN 'small' WHEN area_ratio < 0.2 THEN 'medium' ELSE 'large' END AS bucket, (CASE WHEN area_ratio < 0.05 THEN 3 WHEN area_ratio < 0.2 THEN 2 ELSE 1 END)::BIGINT AS generations FROM ({fx.POOL})), sz AS (SELECT count(*) AS n FROM pool)"
UNIT = "(('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _pool(spark: SparkSession, d: str) -> DataFrame:
    p = fx.pool(spark, d)
    return p.withColumn("bucket", bx.area_bucket(F.col("area_ratio"))).withColumn("generations", bx.generation_count(F.col("area_ratio")))


def _draws(spark: SparkSession, d: str) -> int:
    """Two and a half draws for each object."""
    return int(fx.table(spark, d, "part").count() * 2.5)


BAL = f"bal AS (SELECT *, row_number() OVER (ORDER BY cycle, md5(concat('{SEED}:', cycle, ':', object_id)), object_id) - 1 AS draw FROM pool, (SELECT unnest(range(0, 3)) AS cycle)), b AS MATERIALIZED (SELECT draw, object_id, class_name, area_ratio, bucket, generations FROM bal WHERE draw < (SELECT floor(n * 2.5) FROM sz))"
RND = f"num AS (SELECT *, row_number() OVER (ORDER BY object_id) - 1 AS pos FROM pool), r AS MATERIALIZED (SELECT x.draw, object_id, class_name, area_ratio, bucket, generations FROM (SELECT draw, floor({UNIT.format(f'''concat('{SEED}:', draw)''')} * (SELECT n FROM sz))::BIGINT AS pos FROM (SELECT unnest(range(0, floor(n * 2.5)::BIGINT)) AS draw FROM sz)) x JOIN num USING (pos))"
CAS = f"""gz AS (SELECT class_name, bucket, count(*) AS size FROM pool GROUP BY class_name, bucket), gs AS (SELECT *, row_number() OVER (ORDER BY class_name, bucket) - 1 AS g FROM gz), mem AS (SELECT *, row_number() OVER (PARTITION BY class_name, bucket ORDER BY md5(concat('{SEED}:', object_id)), object_id) - 1 AS pos FROM pool),
ca AS MATERIALIZED (SELECT x.draw, object_id, mem.class_name, area_ratio, mem.bucket, generations FROM (SELECT draw, draw % (SELECT count(*) FROM gs) AS g, draw // (SELECT count(*) FROM gs) AS turn FROM (SELECT unnest(range(0, floor(n * 2.5)::BIGINT)) AS draw FROM sz)) x JOIN gs ON gs.g = x.g JOIN mem ON mem.class_name = gs.class_name AND mem.bucket = gs.bucket AND mem.pos = x.turn % gs.size)"""
DRAW = "draw, object_id, class_name, round(area_ratio, 6) AS area_ratio, bucket, generations"


@query(f"WITH {POOL}, {BAL} SELECT {DRAW} FROM b")
def balanced_sample(spark, d):
    return sampling.balanced_sample(_pool(spark, d), _draws(spark, d), SEED)


@query(f"WITH {POOL}, {RND} SELECT {DRAW} FROM r")
def random_sample(spark, d):
    return sampling.random_sample(_pool(spark, d), _draws(spark, d), SEED)


@query(f"WITH {POOL}, {CAS} SELECT {DRAW} FROM ca")
def class_area_sample(spark, d):
    return sampling.class_area_sample(_pool(spark, d), _draws(spark, d), SEED)


def _cov(t: str, name: str) -> str:
    return f"SELECT '{name}' AS strategy, count(*) AS pool_size, sum(n)::BIGINT AS draws, min(n) AS min_draws, max(n) AS max_draws, round(avg(n), 6) AS mean_draws, count(*) FILTER (n = 0) AS never, (SELECT sum(generations)::BIGINT FROM {t}) AS synthetic_images FROM (SELECT p.object_id, count(s.draw) AS n FROM pool p LEFT JOIN {t} s USING (object_id) GROUP BY 1)"


@query(f"WITH {POOL}, {BAL}, {RND}, {CAS} {_cov('b', 'balanced')} UNION ALL {_cov('r', 'random')} UNION ALL {_cov('ca', 'class_area')}")
def sampling_strategies(spark, d):
    return sampling.compare_strategies(_pool(spark, d), _draws(spark, d), SEED)


@query(f"WITH {POOL}, {BAL} SELECT class_name, bucket, count(*) AS draws, sum(generations)::BIGINT AS synthetic_images FROM b GROUP BY ALL")
def sampling_yield(spark, d):
    return sampling.yield_by(sampling.balanced_sample(_pool(spark, d), _draws(spark, d), SEED), ["class_name", "bucket"])


@query(f"WITH bg AS ({fx.BACKGROUNDS}) SELECT background_id, category FROM bg QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(concat('{SEED}:', background_id)), background_id) <= 100")
def per_category_sample(spark, d):
    return sampling.per_category(fx.backgrounds(spark, d), 100, SEED, "background_id")


@query(f"WITH o AS (SELECT c_custkey AS image_id, row_number() OVER (ORDER BY md5(concat('{SEED}:', c_custkey)), c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT image_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o")
def split_dataset(spark, d):
    return sampling.split_dataset(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id")), (0.7, 0.15), SEED)


@query(f"""WITH w AS (SELECT p_partkey AS image_id, CASE WHEN p_size % 10 = 0 THEN 3 ELSE 1 END::DOUBLE AS weight FROM part), s AS (SELECT image_id, weight, sum(weight) OVER (ORDER BY image_id) AS hi FROM w), t AS (SELECT sum(weight) AS total, count(*) AS n FROM w),
u AS (SELECT draw, {UNIT.format(f'''concat('{SEED}:1:', draw)''')} * total AS u FROM (SELECT unnest(range(0, n)) AS draw, total FROM t)) SELECT draw, image_id, weight FROM u JOIN s ON u.u >= s.hi - s.weight AND u.u < s.hi""")
def weighted_sample(spark, d):
    w = fx.table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.when(F.col("p_size") % 10 == 0, 3.0).otherwise(1.0).alias("weight"))
    return sampling.weighted_sample(w, w.count(), SEED, 1)


# ---- plans and audits of training sets -----------------------------------------------------------------------------

PLAN = f"""WITH {POOL}, bg AS (SELECT *, row_number() OVER (ORDER BY background_id) - 1 AS draw, count(*) OVER () AS nb FROM ({fx.BACKGROUNDS})),
bal AS (SELECT *, row_number() OVER (ORDER BY cycle, md5(concat('{SEED}:', cycle, ':', object_id)), object_id) - 1 AS draw FROM pool, (SELECT unnest(range(0, (SELECT ceil(count(*) / (SELECT n FROM sz))::BIGINT FROM customer))) AS cycle)),
pl AS (SELECT background_id, category, object_id, class_name, area_ratio, bucket, generation, concat_ws('_', background_id::VARCHAR, 'e7', generation::VARCHAR, object_id::VARCHAR) AS name FROM (SELECT *, unnest(range(1, generations + 1)) AS generation FROM bg JOIN bal USING (draw)))"""


@query(f"{PLAN} SELECT name, background_id, object_id, bucket, generation, CASE WHEN {UNIT.format(f'''concat('{SEED}:background:', name)''')} < 0.5 THEN 'external' ELSE 'train' END AS background FROM pl")
def composition_plan(spark, d):
    plan = build.plan_composition(fx.backgrounds(spark, d), fx.pool(spark, d), SEED)
    return build.choose_background(plan, SEED).select("name", "background_id", "object_id", "bucket", "generation", "background")


@query(f"""WITH {POOL}, bg AS (SELECT *, row_number() OVER (ORDER BY background_id) - 1 AS draw, count(*) OVER () AS nb FROM ({fx.BACKGROUNDS})), num AS (SELECT *, row_number() OVER (ORDER BY object_id) - 1 AS pos FROM pool),
dr AS (SELECT bg.*, floor({UNIT.format(f"concat('{SEED}:', draw)")} * (SELECT n FROM sz))::BIGINT AS pos FROM bg), pl AS (SELECT background_id, object_id, class_name, least(object_id % 4, 2) AS k FROM dr JOIN num USING (pos))
SELECT concat_ws('_', background_id::VARCHAR, 'e7', g::VARCHAR, object_id::VARCHAR) AS name, background_id, object_id, class_name AS bucket, g AS generation FROM (SELECT *, unnest(range(1, k + 1)) AS g FROM pl)""")
def composition_plan_of_choice(spark, d):
    pool = fx.pool(spark, d).withColumn("wanted", F.col("object_id") % 4)
    plan = build.plan_composition(fx.backgrounds(spark, d), pool, SEED, sampling.random_sample, build.by_column("wanted", "class_name", 2))
    return plan.select("name", "background_id", "object_id", "bucket", "generation")


PLACED = f"""{PLAN}, p0 AS (SELECT name, 100.0::DOUBLE + object_id % 200 AS ow, 80.0::DOUBLE + object_id % 90 AS oh, {UNIT.format(f'''concat('{SEED}:scale:', name)''')} * (0.35::DOUBLE - 0.1::DOUBLE) + 0.1::DOUBLE AS h FROM pl), p1 AS (SELECT *, greatest(1.0, floor(h * 600)) AS ph FROM p0), p2 AS (SELECT *, ph * ow / oh AS pw FROM p1), p3 AS (SELECT *, least(1.0::DOUBLE, 800 / pw) AS k FROM p2),
p4 AS (SELECT name, greatest(1, floor(pw * k)::BIGINT) AS place_w, greatest(1, floor(ph * k)::BIGINT) AS place_h FROM p3)"""


@query(f"{PLACED} SELECT name, place_w, place_h, floor({UNIT.format(f'''concat('{SEED}:x:', name)''')} * (greatest(0, 800 - place_w) + 1))::BIGINT AS place_x, floor({UNIT.format(f'''concat('{SEED}:y:', name)''')} * (greatest(0, 600 - place_h) + 1))::BIGINT AS place_y FROM p4")
def placements(spark, d):
    plan = build.plan_composition(fx.backgrounds(spark, d), fx.pool(spark, d), SEED)
    sized = plan.withColumns({"width": F.lit(800), "height": F.lit(600), "object_width": F.lit(100.0) + F.col("object_id") % 200, "object_height": F.lit(80.0) + F.col("object_id") % 90})
    return build.place(sized, SEED).select("name", "place_w", "place_h", "place_x", "place_y")


@query(f"WITH {BASE}, t AS (SELECT DISTINCT image_id FROM gt) SELECT image_id, concat('img', image_id) AS stem, 'original' AS kind FROM t UNION ALL SELECT image_id, concat('img', image_id, '_e2'), 'augmented' FROM t WHERE image_id IN (SELECT image_id FROM gt WHERE class_id IN (1, 4))")
def targeted_set(spark, d):
    ann = fx.gt(spark, d)
    train = ann.select("image_id").distinct().withColumn("stem", F.concat(F.lit("img"), F.col("image_id").cast("string")))
    return build.targeted_set(train, ann, [1, 4])


@query(f"""WITH {BASE}, n AS (SELECT image_id, gt_idx, 1 - (x1 + x2) / 2 / 500 AS cx, (y1 + y2) / 2 / 400 AS cy, (x2 - x1) / 500 AS w, (y2 - y1) / 400 AS h FROM gt), s AS (SELECT image_id, gt_idx, (cx - 0.5) * 1.5 + 0.5 AS cx, (cy - 0.5) * 1.5 + 0.5 AS cy, w * 1.5 AS w, h * 1.5 AS h FROM n),
c AS (SELECT *, greatest(0, least(1, cx - w / 2)) AS a, greatest(0, least(1, cy - h / 2)) AS b, greatest(0, least(1, cx + w / 2)) AS c, greatest(0, least(1, cy + h / 2)) AS d FROM s)
SELECT image_id, gt_idx::BIGINT AS gt_idx, round((a + c) / 2, 6) AS cx, round((b + d) / 2, 6) AS cy, round(c - a, 6) AS w, round(d - b, 6) AS h FROM c WHERE (c - a) * (d - b) / (w * h) >= 0.2""")
def transformed_boxes(spark, d):
    g = fx.gt(spark, d)
    norm = g.select("image_id", "gt_idx", ((F.col("x1") + F.col("x2")) / 2 / 500).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / 400).alias("cy"), ((F.col("x2") - F.col("x1")) / 500).alias("w"), ((F.col("y2") - F.col("y1")) / 400).alias("h"))
    return build.transform_boxes(norm, flip=True, scale=1.5)


@query(f"""WITH {BASE}, ll AS ({fx.LABEL_LINES}), t AS (SELECT *, string_split(line, ' ') AS t FROM ll), v AS (SELECT *, list_transform(t, lambda x: try_cast(x AS DOUBLE)) AS v FROM t)
SELECT image_id, line_no::BIGINT AS line_no, line, CASE WHEN len(t) <> 5 THEN 'token_count' WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'not_numeric' WHEN v[1] < 0 OR v[1] >= 5 THEN 'class_range'
  WHEN NOT v[2] BETWEEN 0 AND 1 OR NOT v[3] BETWEEN 0 AND 1 THEN 'center_range' WHEN v[4] <= 0 OR v[4] > 1 OR v[5] <= 0 OR v[5] > 1 THEN 'size_range'
  WHEN v[2] - v[4] / 2 < -1e-5 OR v[2] + v[4] / 2 > 1 + 1e-5 OR v[3] - v[5] / 2 < -1e-5 OR v[3] + v[5] / 2 > 1 + 1e-5 THEN 'outside' END AS problem FROM v""")
def label_audit(spark, d):
    return build.audit_labels(fx.label_lines(spark, d), 5)


STRUCT = "im AS (SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, CASE WHEN o_orderkey % 211 = 0 THEN 'img0' ELSE concat('img', o_orderkey) END AS stem FROM orders WHERE o_orderkey % 97 <> 1), lb AS (SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, concat('img', o_orderkey) AS stem FROM orders WHERE o_orderkey % 89 <> 1)"


@query(f"""WITH {STRUCT} SELECT 'image_without_label' AS problem, split, stem FROM im WHERE (split, stem) NOT IN (SELECT (split, stem) FROM lb) UNION ALL SELECT 'label_without_image', split, stem FROM lb WHERE (split, stem) NOT IN (SELECT (split, stem) FROM im)
UNION ALL SELECT 'duplicate_stem', split, stem FROM im GROUP BY split, stem HAVING count(*) > 1 UNION ALL SELECT 'missing_split', 'test', NULL""")
def structure_audit(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("val").alias("split"), F.concat(F.lit("img"), F.col("o_orderkey").cast("string")).alias("name"))
    images = o.where("o_orderkey % 97 <> 1").select("split", F.when(F.col("o_orderkey") % 211 == 0, "img0").otherwise(F.col("name")).alias("stem"))
    return build.audit_structure(images, o.where("o_orderkey % 89 <> 1").select("split", F.col("name").alias("stem")))


OVER = """src AS (SELECT concat('s', c_custkey) AS stem, md5(c_custkey::VARCHAR) AS label_hash, c_custkey AS k FROM customer),
ou AS (SELECT stem, stem AS source_stem, 'original' AS kind, label_hash FROM src WHERE k % 101 <> 3 UNION ALL SELECT concat(stem, '_r', i), stem, 'copy', CASE WHEN k % 103 = 5 THEN 'bad' ELSE label_hash END FROM (SELECT *, unnest(range(1, k % 3 + 1)) AS i FROM src WHERE k % 4 = 0)),
ex AS (SELECT stem AS source_stem, CASE WHEN k % 107 = 8 THEN 7 ELSE k % 3 END AS copies FROM src WHERE k % 4 = 0)"""


@query(f"""WITH {OVER} SELECT 'original_missing' AS problem, stem AS name, NULL::VARCHAR AS detail FROM src WHERE stem NOT IN (SELECT stem FROM ou WHERE kind = 'original')
UNION ALL SELECT 'label_differs', ou.stem, NULL FROM ou JOIN src ON src.stem = ou.source_stem WHERE ou.label_hash <> src.label_hash
UNION ALL SELECT 'copy_count', source_stem, concat(coalesce(n, 0), '/', coalesce(copies, 0)) FROM ex FULL JOIN (SELECT source_stem, count(*) AS n FROM ou WHERE kind = 'copy' GROUP BY 1) USING (source_stem) WHERE coalesce(n, 0) <> coalesce(copies, 0)""")
def oversample_audit(spark, d):
    return build.audit_oversample(*oversampled(spark, d))


def oversampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source, output and expected copies of an oversampled set with planted faults."""
    c = fx.table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("stem"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("label_hash"), F.col("c_custkey").alias("k"))
    four = c.where("k % 4 = 0")
    copies = four.where("k % 3 > 0").withColumn("i", F.explode(F.expr("sequence(1, cast(k % 3 AS int))")))
    out = c.where("k % 101 <> 3").select("stem", F.col("stem").alias("source_stem"), F.lit("original").alias("kind"), "label_hash").unionByName(
        copies.select(F.concat("stem", F.lit("_r"), F.col("i").cast("string")).alias("stem"), F.col("stem").alias("source_stem"), F.lit("copy").alias("kind"), F.when(F.col("k") % 103 == 5, "bad").otherwise(F.col("label_hash")).alias("label_hash"))
    )
    expected = four.select(F.col("stem").alias("source_stem"), F.when(F.col("k") % 107 == 8, 7).otherwise(F.col("k") % 3).alias("copies"))
    return c.select("stem", "label_hash"), out, expected


@query("SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 50 = 0")
def leakage(spark, d):
    o = fx.table(spark, d, "orders")
    return build.leakage(o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("image_id")), o.where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("image_id")))


@query("SELECT page_id, concat('bg_', substr(sha256(url), 1, 12)) AS background_id, lower(regexp_replace(replace(url, '\\', '/'), '/+', '/', 'g')) AS norm, regexp_extract(url, '[^/]*$') AS base FROM pages")
def background_ids(spark, d):
    from tessera.sources.files import collect_backgrounds

    p = fx.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.lit(4).alias("width"), F.lit(3).alias("height"))
    ids = collect_backgrounds(p, " Web ", "pages").select("background_id", F.col("image_path").alias("path"))
    return p.join(ids.distinct(), "path").select("page_id", "background_id", bx.norm_path("path").alias("norm"), bx.base_name("path").alias("base"))


# ---- latency -------------------------------------------------------------------------------------------------------

LAT = "count(*) AS n, round(avg(ms), 6) AS mean_ms, round(median(ms), 6) AS median_ms, round(stddev_pop(ms), 6) AS std_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, CASE WHEN avg(ms) > 0 THEN round(1000 / avg(ms), 6) ELSE 0 END AS fps"
TIM = f"WITH t AS (SELECT * FROM ({fx.TIMINGS}) WHERE ms >= 0 AND isfinite(ms))"


@query(f"{TIM} SELECT runtime, {LAT} FROM t GROUP BY 1")
def latency_stats(spark, d):
    return latency.latency_stats(fx.timings(spark, d))


@query(f"{TIM} SELECT runtime, {LAT} FROM (SELECT runtime, image, avg(ms) AS ms FROM t GROUP BY ALL) GROUP BY 1")
def latency_two_stage(spark, d):
    return latency.latency_two_stage(fx.timings(spark, d))


@query(f"{TIM}, s AS (SELECT runtime, avg(ms) AS m FROM t GROUP BY 1) SELECT a.runtime AS baseline, b.runtime AS comparison, CASE WHEN a.m > 0 AND b.m > 0 THEN round(a.m / b.m, 6) ELSE 0 END AS speedup FROM s a, s b WHERE a.runtime < b.runtime")
def speedups(spark, d):
    s = latency.latency_stats(fx.timings(spark, d)).select("runtime", "mean_ms")
    names = sorted(r["runtime"] for r in s.collect())  # a row for each runtime
    return latency.speedups(s, [(a, b) for a in names for b in names if a < b])


@query(f"""{TIM}, o AS (SELECT runtime, avg(ms) AS ms, 1000 / avg(ms) AS fps FROM t WHERE image % 2 = 0 GROUP BY 1), n AS (SELECT runtime, avg(ms) AS ms, 1000 / avg(ms) AS fps FROM t WHERE image % 2 = 1 GROUP BY 1)
SELECT runtime, round(o.ms, 6) AS old_ms, round(o.fps, 6) AS old_fps, round(n.ms, 6) AS new_ms, round(n.fps, 6) AS new_fps, round(n.ms - o.ms, 6) AS ms_change, round(100 * (n.ms - o.ms) / o.ms, 6) AS ms_change_pct, round(n.fps - o.fps, 6) AS fps_change, round(100 * (n.fps - o.fps) / o.fps, 6) AS fps_change_pct FROM o JOIN n USING (runtime)""")
def benchmark_compare(spark, d):
    t = fx.timings(spark, d)
    return latency.compare_benchmarks(latency.latency_stats(t.where("image % 2 = 0")), latency.latency_stats(t.where("image % 2 = 1")))



NAMES = "SELECT CASE dense_rank() OVER (ORDER BY runtime) WHEN 1 THEN 'pytorch' WHEN 2 THEN 'pytorch' ELSE 'onnx' END AS kind, CASE dense_rank() OVER (ORDER BY runtime) % 2 WHEN 1 THEN 'cpu' ELSE 'gpu' END AS device, ms, odd FROM s QUALIFY dense_rank() OVER (ORDER BY runtime) <= 4"


@query(f"""{TIM}, s AS (SELECT runtime, image % 2 AS odd, round(avg(ms), 3) AS ms FROM t GROUP BY 1, 2), k AS ({NAMES})
SELECT CASE WHEN odd = 1 THEN 'flat' ELSE 'nested' END AS file, kind || '_' || device AS runtime, ms, round(CASE WHEN odd = 1 THEN 7.5 WHEN ms > 0 THEN 1000 / ms ELSE 0 END::DOUBLE, 6) AS fps FROM k""")
def benchmark_files(spark, d):
    """The mean times as benchmark files in both layouts, read again."""
    t = fx.timings(spark, d).where("ms >= 0 AND NOT isnan(ms)").groupBy("runtime", (F.col("image") % 2).alias("odd")).agg(F.round(F.avg("ms"), 3).alias("ms"))
    t.createOrReplaceTempView("s")
    k = spark.sql("SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY runtime) AS r FROM s) WHERE r <= 4").selectExpr("odd", "ms", "CASE WHEN r <= 2 THEN 'pytorch' ELSE 'onnx' END AS kind", "CASE WHEN r % 2 = 1 THEN 'cpu' ELSE 'gpu' END AS device")
    entry = lambda key, *v: F.map_from_entries(F.collect_list(F.struct(key, F.struct(*v))))
    flat = k.where("odd = 1").agg(F.to_json(F.struct(entry(F.concat_ws("_", "kind", "device"), F.col("ms").alias("mean_ms"), F.lit(7.5).alias("fps")).alias("results"))).alias("content"))
    kinds = k.where("odd = 0").groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("device", F.struct(F.col("ms").alias("mean_ms"))))).alias("m"))
    nested = kinds.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("results"))).alias("content"))
    return latency.parse_benchmarks(flat.select(F.lit("flat").alias("file"), "content").unionByName(nested.select(F.lit("nested").alias("file"), "content")))


from tessera import queries_more  # noqa: E402, F401  (registers its queries here)
