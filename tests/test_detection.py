"""Operators against small cases worked out by hand or by plain loops."""

import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions import boxes as bx
from tessera.operators import bank, build, compare, errors, latency, matching, metrics, sampling, scoring, similarity

# Workers cannot import test modules, so functions of this one travel as they are.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
BOX = "image_id long, {idx} int, class_id bigint, {conf}x1 double, y1 double, x2 double, y2 double"


def preds(spark, rows):
    return spark.createDataFrame(rows, BOX.format(idx="pred_idx", conf="confidence double, "))


def gts(spark, rows):
    return spark.createDataFrame(rows, BOX.format(idx="gt_idx", conf=""))


def py_iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / u if u > 0 else 0.0


def loop_match(p, g, by_conf, least=0.5):
    out = set()
    for image in {x[0] for x in p}:
        used = set()
        mine = [x for x in p if x[0] == image]
        for x in sorted(mine, key=lambda x: (-x[3], x[1]) if by_conf else x[1]):
            best, at = 0.0, None
            for y in sorted((y for y in g if y[0] == image), key=lambda y: y[1]):
                v = py_iou(x[4:], y[3:])
                if y[1] not in used and v > best:
                    best, at = v, y[1]
            if at is not None and best >= least:
                used.add(at)
                out.add((image, x[1], at))
    return out


def test_matching_equals_the_loop(spark):
    r = random.Random(3)
    p, g = [], []
    for image in range(30):
        for i in range(r.randint(0, 8)):
            x, y = r.randint(0, 30), r.randint(0, 30)
            g.append((image, i, r.randint(0, 3), float(x), float(y), float(x + 20), float(y + 20)))
        for i in range(r.randint(0, 10)):
            x, y = r.randint(0, 30), r.randint(0, 30)
            p.append((image, i, r.randint(0, 3), r.randint(1, 5) / 5, float(x), float(y), float(x + 20), float(y + 20)))
    for order in ("confidence", "input"):
        got = {(x["image_id"], x["pred_idx"], x["gt_idx"]) for x in matching.match_pairs(preds(spark, p), gts(spark, g), order=order).collect()}
        assert got == loop_match(p, g, order == "confidence")
    full = matching.match_detections(preds(spark, p), gts(spark, g)).groupBy("status").count().collect()
    n = {x["status"]: x["count"] for x in full}
    assert n["match"] + n["fp"] == len(p) and n["match"] + n["fn"] == len(g)
    with pytest.raises(ValueError):
        matching.match_pairs(preds(spark, p), gts(spark, g), order="banana")


def test_nms_keeps_the_best_of_each_cluster(spark):
    p = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.8, 1.0, 0.0, 11.0, 10.0), (1, 2, 1, 0.7, 0.0, 0.0, 10.0, 10.0), (1, 3, 0, 0.6, 50.0, 50.0, 60.0, 60.0), (1, 4, 0, 0.5, 5.0, 5.0, 5.0, 5.0)]
    ids = lambda df: sorted(x["pred_idx"] for x in df.collect())
    assert ids(matching.nms(preds(spark, p))) == [0, 3, 4]
    assert ids(matching.nms(preds(spark, p), per_class=True)) == [0, 2, 3, 4]
    assert ids(matching.nms(preds(spark, p), per_class=True, most=2)) == [0, 2]


def test_average_precision_by_hand(spark):
    g = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, 0.0, 0.0, 10.0, 10.0), (3, 0, 0, 0.0, 0.0, 10.0, 10.0), (3, 1, 1, 0.0, 0.0, 10.0, 10.0)]
    p = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0, 0.8, 40.0, 0.0, 50.0, 10.0), (2, 0, 0, 0.7, 0.0, 0.0, 10.0, 10.0)]
    m = {x["class_id"]: x for x in metrics.detection_metrics(preds(spark, p), gts(spark, g)).collect()}
    assert m[0]["ap"] == pytest.approx(1 / 3 + (2 / 3) / 3) and m[0]["precision"] == pytest.approx(2 / 3) and m[0]["recall"] == pytest.approx(2 / 3)
    assert (m[1]["ap"], m[1]["n_pred"], m[1]["recall"]) == (0.0, 0, 0.0)
    row = metrics.mean_ap(metrics.detection_metrics(preds(spark, p), gts(spark, g), metrics.IOUS)).first()
    assert row["map50"] == pytest.approx(row["map75"]) == pytest.approx(row["map50_95"])


def test_box_expressions(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.25, 100, 80), (0.0, 0.0, 0.1, 0.1, 100, 80)], "cx double, cy double, w double, h double, wide int, tall int")
    got = df.select(F.array(*bx.yolo_to_xyxy("cx", "cy", "w", "h", "wide", "tall")).alias("a"), F.array(*bx.yolo_to_int_box("cx", "cy", "w", "h", "wide", "tall")).alias("b")).collect()
    assert got[0]["a"] == [25.0, 30.0, 75.0, 50.0] and got[0]["b"] == [25, 30, 75, 50] and got[1]["b"] == [0, 0, 5, 4]
    one = spark.range(1)
    assert one.select(bx.safe_double(F.lit("x")).alias("a"), bx.safe_double(F.lit("inf")).alias("b"), bx.safe_int(F.lit("7.0")).alias("c"), bx.base_name(F.lit(r"a\b/c.JPG")).alias("d"), bx.stem(F.lit("a/b.tar.gz")).alias("e")).first() == (None, None, 7, "c.JPG", "b.tar")
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one.select(bx.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0)).alias("a"), bx.box_valid(lit(1, 1, 1, 2), True).alias("b"), bx.box_valid(lit(1, 1, 1, 2), False).alias("c")).first() == (0.0, False, True)
    assert one.select(bx.clip_crop(lit(-5, 2.9, 30, 9), 20, 10).alias("a")).first()[0] == (0, 2, 20, 9)
    assert one.select(bx.clip_crop(lit(-9, 2, -3, 9), 20, 10).alias("a")).first()[0] is None
    e = one.select(bx.extent_to_yolo(0, 0, 9, 9, 10, 20, 100, 50).alias("a")).first()[0]
    assert (e["cx"], e["cy"], e["w"], e["h"]) == (0.15, 0.5, 0.1, 0.2)
    u = one.select(*[c.alias(n) for c, n in zip(bx.unletterbox(320.0, 320.0, 100.0, 50.0, 2.0, 0.0, 140.0, 320, 180), "abcd", strict=True)]).first()
    assert tuple(u) == (135.0, 77.5, 185.0, 102.5)
    kinds = [r[0] for r in spark.createDataFrame([(0.8,), (0.49,), (0.6,), (None,)], "v double").select(bx.confusion_kind("v")).collect()]
    assert kinds == ["classification_dominant", "localization_dominant", "mixed", "unknown"]
    paths = spark.createDataFrame([("/d/train/a.jpg", "train"), ("/d/val/a.jpg", "train"), ("/d/train/b.jpg", "val")], "path string, split string")
    assert [r["path"] for r in bx.train_only(paths, "/d/train").collect()] == ["/d/train/a.jpg"]


def test_ranking(spark):
    df = spark.createDataFrame([("metal", "glass", 23), ("glass", "metal", 17), ("plastic", "glass", 11), ("metal", "plastic", 8), ("glass", "plastic", 5)], "gt_class string, pred_class string, count int")
    assert [r["count"] for r in errors.rank(df, "count", ["gt_class"], 2).collect()] == [23, 17]
    assert errors.rank(df, "count", ["gt_class"], 0).count() == 0 and errors.rank(df, "count", ["gt_class"]).count() == 5
    with pytest.raises(ValueError):
        errors.rank(df, "banana", ["gt_class"])
    ap = spark.createDataFrame([("plastic", 0.719), ("glass", 0.744), ("metal", 0.834)], "class_id string, ap double")
    assert [r["class_id"] for r in errors.rank(ap, "ap", ["class_id"]).collect()] == ["plastic", "glass", "metal"] and errors.rank(ap, "ap", ["class_id"]).first()["priority_score"] == 0.719 and errors.worst_class(ap).first()["class_id"] == "plastic"
    assert spark.range(1).select(errors.policy_score(F.lit(1.0), F.lit(0.5))).first()[0] == 0.75
    with pytest.raises(ValueError):
        errors.policy_score()


def test_samplers(spark):
    pool = spark.createDataFrame([(i, "abc"[i % 3], "small") for i in range(10)], "object_id long, class_name string, bucket string")
    draws = [r["object_id"] for r in sampling.balanced_sample(pool, 25, 7).orderBy("draw").collect()]
    assert sorted(draws[:10]) == sorted(draws[10:20]) == list(range(10)) and len(set(draws[20:])) == 5 and draws[:10] != draws[10:20]
    assert draws == [r["object_id"] for r in sampling.balanced_sample(pool, 25, 7).orderBy("draw").collect()]
    c = sampling.class_area_sample(pool, 12, 7).groupBy("class_name").count().collect()
    assert {r["class_name"]: r["count"] for r in c} == {"a": 4, "b": 4, "c": 4}
    w = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "image_id long, weight double")
    n = {r["image_id"]: r["count"] for r in sampling.weighted_sample(w, 4000, 5).groupBy("image_id").count().collect()}
    assert set(n) == {0, 1} and 2800 < n[1] < 3200 and sum(n.values()) == 4000
    images = spark.range(20).withColumnRenamed("id", "image_id")
    s = {r["split"]: r["count"] for r in sampling.split_dataset(images, (0.7, 0.15), 1).groupBy("split").count().collect()}
    assert s == {"train": 14, "val": 3, "test": 3}
    assert sampling.subset(images, 5, 1).count() == 5 and sampling.subset(images, 50, 1).count() == 20 and sampling.take_fraction(images, 0.25, 1).count() == 5
    with pytest.raises(ValueError):
        sampling.subset(images, 50, 1, strict=True)
    assert sampling.coverage(pool, sampling.balanced_sample(pool, 5, 1)).first()["never"] == 5


def test_accept_in_order_equals_the_loop(spark):
    r = random.Random(9)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(12)]
    rows = []
    for i in range(120):
        h = r.choice(hashes)
        for _ in range(r.randint(0, 6)):
            h ^= 1 << r.randrange(63)
        rows.append((i, h, f"c{r.randint(0, 200)}", r.random() < 0.9))
    accepted = []
    for i, h, _, ok in rows:
        if ok and all(bin((h ^ rows[j][1]) & (2**64 - 1)).count("1") > 8 for j in accepted):
            accepted.append(i)
    df = spark.createDataFrame(rows, "path long, perceptual_hash long, content_hash string, usable boolean")
    state = bank.accept_in_order(df)
    assert sorted(x["id"] for x in state.where("accepted").collect()) == accepted
    near = {x["id"] for x in bank.duplicate_reasons(df, state).where("array_contains(reasons, 'near_duplicate')").collect()}
    assert near == {i for i, h, *_ in rows if any(j < i and bin((h ^ rows[j][1]) & (2**64 - 1)).count("1") <= 8 for j in accepted)}
    assert bank.bank_summary(df).first()["total"] == 120
    links = {frozenset((x["a"], x["b"])) for x in bank.near_pairs(df).collect()}
    far = lambda a, b: bin((rows[a][1] ^ rows[b][1]) & (2**64 - 1)).count("1")
    first = {h: min(i for i, g, *_ in rows if g == h) for _, h, *_ in rows}
    want = {frozenset((a, b)) for a in first.values() for b in first.values() if a < b and far(a, b) <= 8}
    assert links == want | {frozenset((first[h], i)) for i, h, *_ in rows if i != first[h]}


def test_image_quality_and_hash(spark):
    g = np.random.Generator(np.random.PCG64(1))
    noise = g.integers(0, 256, (60, 80, 3)).astype(np.uint8)
    grid = np.kron(g.integers(0, 2, (8, 10)) * 255, np.ones((8, 8))).astype(np.uint8)[:60, :80, None].repeat(3, 2)
    small = noise.reshape(30, 2, 40, 2, 3).mean(axis=(1, 3)).astype(np.uint8)
    rows = [("noise.png", 60, 80, 3, noise.tobytes()), ("small.png", 30, 40, 3, small.tobytes()), ("grid.png", 60, 80, 3, grid.tobytes()), ("flat.png", 60, 80, 3, bytes(60 * 80 * 3)), ("bad.png", -1, -1, -1, None)]
    facts = bank.image_quality(bank.pixel_facts(spark.createDataFrame(rows, "path string, height int, width int, nChannels int, data binary")))
    q = {r["path"]: r for r in bank.validate_images(facts, 40, 30).collect()}
    assert q["noise.png"]["usable"] and not q["small.png"]["reasons"].count("image_unreadable") and q["bad.png"]["reasons"] == ["image_unreadable"]
    assert {"image_blurry", "image_too_dark", "low_contrast", "quality_score_too_low"} <= set(q["flat.png"]["reasons"])
    far = lambda a, b: bin((q[a]["perceptual_hash"] ^ q[b]["perceptual_hash"]) & (2**64 - 1)).count("1")
    assert far("noise.png", "small.png") <= 8 < far("noise.png", "grid.png")


def test_oversample_and_weights(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "b")], "image_id long, stem string")
    objects = spark.createDataFrame([(1, 2, 5)], "image_id long, selection_count long, global_rank long")
    assert sorted(r["stem"] for r in similarity.oversample(samples, objects).collect()) == ["a", "a__e4hm_rank0005_rep01", "a__e4hm_rank0005_rep02", "b"]
    w = similarity.image_weights(samples.select("image_id"), objects)
    assert {r["image_id"]: r["weight"] for r in w.collect()} == {1: 3.0, 2: 1.0}
    with pytest.raises(ValueError):
        similarity.image_weights(samples, objects, 0)


def test_cosine_errors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(similarity.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2**-0.5)
    for bad in ([0.0, 0.0], [1.0]):
        with pytest.raises(Exception, match="vectors must"):
            spark.createDataFrame([([1.0, 0.0], bad)], "a array<double>, b array<double>").select(similarity.cosine(F.col("a"), F.col("b"))).collect()


def test_latency(spark):
    t = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 2, None), ("a", 3, float("nan")), ("b", 1, -1.0)], "runtime string, image int, ms double")
    row = latency.latency_stats(t).first()
    assert (row["n"], row["median_ms"], row["p95_ms"]) == (3, 2.0, pytest.approx(3.8)) and row["fps"] == pytest.approx(3000 / 7)
    assert latency.check_timings(t).count() == 3 and latency.latency_two_stage(t).first()["mean_ms"] == 2.75
    with pytest.raises(Exception, match="negative"):
        latency.latency_stats(t, strict=True).collect()
    a = spark.createDataFrame([([1.0, 2.0], [1.0, 2.5]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = latency.array_agreement(a).collect()
    assert (got[0]["max_abs_diff"], got[0]["mean_abs_diff"], got[1]["same_shape"]) == (0.5, 0.25, False)


def test_compare_small_parts(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    b = spark.createDataFrame([("y", 9), ("z", 3)], "name string, v int")
    assert sorted(map(tuple, compare.merge_samples(a, b).collect())) == [("x", 1), ("y", 2), ("z", 3)]
    assert sorted(map(tuple, compare.name_diff(a, b).collect())) == [("x", "missing"), ("z", "unexpected")]
    d = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, pos int, v string")
    assert compare.first_by_key(d, ["key"], ["pos"]).first()["v"] == "a"
    report = spark.createDataFrame([("train", "x", None), ("val", "x", "y")], "split string, error_analysis string, per_class_metrics string")
    found = [x["problems"] for x in compare.check_report(report).orderBy("split").collect()]
    assert found == [["missing:per_class_metrics", "missing:class_performance_summary", "warning:split=train"], ["missing:class_performance_summary"]]
    assert compare.check_report(report.drop("split")).first()["problems"][0] == "missing:split"
    both, only_a, only_b = compare.image_set_diff(a.withColumnRenamed("name", "image_id"), b.withColumnRenamed("name", "image_id"))
    assert (both.count(), only_a.count(), only_b.count()) == (1, 1, 1)


def test_composition(spark):
    bg = np.full((40, 60, 3), 200, np.uint8)
    obj = np.zeros((10, 10, 4), np.uint8)
    obj[2:8, 2:8] = (10, 20, 30, 255)
    out, mask, box = build.compose_one(bg, obj, 5, 6, 20, 20)
    assert box == (9, 10, 21, 22) and (out[0, 0] == 200).all() and (out[15, 15] != 200).any() and mask.shape == (20, 20) and set(np.unique(mask)) == {0, 255}
    assert build.compose_one(bg, np.zeros((4, 4, 4), np.uint8), 0, 0, 4, 4)[2] is None
    plan = spark.createDataFrame([("n1", 1, 7, 5, 6, 20, 20), ("n2", 1, 8, 5, 6, 20, 20), ("n3", 1, 7, 50, 6, 20, 20)], "name string, background_id long, object_id long, place_x int, place_y int, place_h int, place_w int")
    images = spark.createDataFrame([(1, 40, 60, bg.tobytes())], "background_id long, height int, width int, data binary")
    objects = spark.createDataFrame([(7, 10, 10, obj.tobytes()), (8, 10, 10, b"short")], "object_id long, object_height int, object_width int, rgba binary")
    got = {r["name"]: r for r in build.compose(plan, images, objects, 3).collect()}
    assert got["n1"]["error"] is None and len(got["n1"]["data"]) == bg.size and len(got["n1"]["mask"]) == 400 and got["n2"]["error"] and "out of the background" in got["n3"]["error"]


def test_composition_by_hand():
    """Each raster step with numbers worked out on paper."""
    px = lambda *v: np.array(v, np.uint8)[None]
    # Light: grey 100 is 100 / 127.5; blue 100, green 150, red 200 are (186800 + 1442550 + 979800 + 8192) >> 14 = 159.
    assert build.scene_light(np.full((2, 2, 3), 100, np.uint8)) == pytest.approx(100 / 127.5)
    assert build.scene_light(px((100, 150, 200))) == pytest.approx(159 / 127.5)
    # 101 * 0.5 is cut off to 50; then +7 on blue and -7 on red, no wrap below 0; alpha stays.
    assert build.transformed(px((101, 9, 11, 40)), 0.5, 7).tolist() == [[[57, 4, 0, 40]]]
    assert build.transformed(px((101, 9, 11, 40)), 0.5, -7).tolist() == [[[43, 4, 12, 40]]]
    assert build.transformed(px((200, 9, 11, 40)), 2.0).tolist() == [[[255, 18, 22, 40]]]
    # Highlight of 0.25 over three columns: 63.75, 31.875 and 0 on every colour, inside the object only.
    assert build.transformed(px((10, 20, 250, 9), (10, 20, 250, 9), (10, 20, 250, 9)), 1.0, reflection=0.25)[0, :, :3].tolist() == [[73, 83, 255], [41, 51, 255], [10, 20, 250]]
    # Of 5 rows 0.35 is 1.75, cut off to 1: the last one is hidden.
    assert build.transformed(np.full((5, 1, 4), 200, np.uint8), 1.0, occlusion=0.35)[:, 0, 3].tolist() == [200, 200, 200, 200, 0]
    # Areas: 3 pixels to 2 are (2 a + b) / 3; 2 to 3 share the middle one; alpha likewise, and 1/3 of 1 rounds to 0.
    row = lambda *v: np.array(v, np.uint8)[None, :, None]
    assert build.resize_area(row(0, 30, 90), 1, 2)[0, :, 0].tolist() == [10, 70]
    assert build.resize_area(row(0, 90), 1, 3)[0, :, 0].tolist() == [0, 45, 90]
    # Blend: alpha 51 is 0.2, so 0.2 * 100 + 0.8 * 60 = 68; alpha 1 counts for the mask and the box.
    bg = np.full((1, 3, 3), 60, np.uint8)
    obj = np.array([[(100, 100, 100, 51), (100, 100, 100, 1), (0, 0, 0, 0)]], np.uint8)
    obj[:, :, :3] = np.round(obj[:, :, :3] / build.scene_light(bg) + 0.4)
    out, mask, box = build.compose_one(bg, obj, 0, 0, 1, 3)
    assert out[0, :, 0].tolist() == [68, 60, 60] and mask.tolist() == [[255, 255, 0]] and box == (0, 0, 2, 1)


def test_samplers_and_strategies_are_the_callers(spark):
    """Two samplers give two plans; a strategy may make no image of an object; thresholds are checked."""
    backgrounds = spark.createDataFrame([(f"b{i}",) for i in range(6)], "background_id string")
    pool = spark.createDataFrame([(i, (0.01, 0.1, 0.5)[i % 3], i % 3) for i in range(9)], "object_id long, area_ratio double, wanted int")
    plain = build.plan_composition(backgrounds, pool, 1).collect()
    drawn = build.plan_composition(backgrounds, pool, 1, sampling.random_sample).collect()
    assert len({r["object_id"] for r in plain}) == 6 and {r["name"] for r in plain} != {r["name"] for r in drawn}
    assert all((r["bucket"], r["generation"] <= n) == (b, True) for r in plain for b, n in [{0.01: ("small", 3), 0.1: ("medium", 2), 0.5: ("large", 1)}[r["area_ratio"]]])
    first = lambda p, n, seed: p.where("object_id < 3").withColumn("draw", F.col("object_id"))
    own = build.plan_composition(backgrounds, pool, 1, first, build.by_column("wanted", "object_id", 1)).collect()
    assert sorted((r["background_id"], r["object_id"], r["bucket"], r["generation"]) for r in own) == [("b1", 1, 1, 1), ("b2", 2, 2, 1)]
    with pytest.raises(ValueError):
        build.by_area(small=0.3)


def test_counts_are_taken_while_a_table_is_written(spark, tmp_path):
    from tessera.plans import jobs

    samples = spark.createDataFrame([("original", "a"), ("synthetic", "a"), ("synthetic", "b"), ("failed", "b")], "kind string, source string")
    assert jobs.write_counted(samples, f"{tmp_path}/build", build.build_counts()) == {"original_images": 1, "synthetic_images": 2, "failures": 1}
    assert spark.read.parquet(f"{tmp_path}/build").count() == 4 and build.build_summary(samples).first()["source_images"] == 2
    image = bytes(range(48))
    rows = [("i", 0, "glass", 4, 4, 0, 0, 2, 2, image, b"\xff" * 16), ("i", 1, "glass", 4, 4, 0, 0, 2, 2, image, bytes(16)), ("j", 0, "glass", 4, 4, 0, 0, 2, 2, None, None)]
    objects = build.extract_objects(spark.createDataFrame(rows, "image_id string, object_index int, class_name string, height int, width int, x1 int, y1 int, x2 int, y2 int, data binary, mask binary"))
    assert jobs.write_counted(objects, f"{tmp_path}/objects", build.extraction_counts()) == {"objects": 3, "extracted": 1, "failures": 2, "no_pixels": 1, "empty_mask": 1}
    times = spark.createDataFrame([(5.0,), (15.0,)], "inference_ms double")
    assert jobs.write_counted(times, f"{tmp_path}/times", latency.scoring_counts()) == latency.scoring_summary(times).first().asDict() == {"n_images": 2, "total_ms": 20.0, "avg_ms": 10.0, "fps": 100.0}


def test_benchmark_files_of_both_layouts(spark, tmp_path):
    texts = {
        "nested": '{"results": {"pytorch": {"cpu": {"mean_ms": 20, "fps": 49.5}, "gpu": {"mean_ms": "4"}}, "onnx": {"cpu": {"fps": 3}, "gpu": 7}, "onnx_cpu": {"mean_ms": 1}}}',
        "flat": '{"results": {"pytorch": {"cpu": {}}, "pytorch_cpu": {"mean_ms": 0}, "onnx_gpu": {"mean_ms": 8.0, "fps": null}, "onnx_cpu": {"mean_ms": "x"}, "other": {"mean_ms": 1}}}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name} 1.json").write_text(text)
    got = sorted((r["path"].rsplit("/", 1)[1], r["runtime"], r["ms"], r["fps"]) for r in latency.read_benchmarks(spark, str(tmp_path)).collect())
    assert got == [("flat 1.json", "onnx_gpu", 8.0, 125.0), ("flat 1.json", "pytorch_cpu", 0.0, 0.0), ("nested 1.json", "pytorch_cpu", 20.0, 49.5), ("nested 1.json", "pytorch_gpu", 4.0, 250.0)]
    for bad in ('{"results": {}}', '{"result": 1}', "no json"):
        with pytest.raises(Exception):
            latency.parse_benchmarks(spark.createDataFrame([(bad,)], "content string")).collect()
    both = latency.compare_benchmarks(*(latency.read_benchmarks(spark, str(tmp_path / f)) for f in ("nested 1.json", "flat 1.json"))).collect()
    assert [(r["runtime"], r["ms_change"], r["ms_change_pct"]) for r in both] == [("pytorch_cpu", -20.0, -100.0)]


def test_object_extraction(spark):
    image = np.arange(20 * 30 * 3, dtype=np.uint32).astype(np.uint8).reshape(20, 30, 3)
    mask = np.zeros((20, 30), np.uint8)
    mask[5:10, 5:10] = 255
    rows = [("i", 0, "glass", 20, 30, 4, 4, 14, 14, image.tobytes(), mask.tobytes()), ("i", 1, "glass", 20, 30, 0, 0, 3, 3, image.tobytes(), mask.tobytes()), ("j", 0, "glass", 20, 30, 0, 0, 3, 3, None, None)]
    df = spark.createDataFrame(rows, "image_id string, object_index int, class_name string, height int, width int, x1 int, y1 int, x2 int, y2 int, data binary, mask binary")
    got = {(r["image_id"], r["object_index"]): r for r in build.extract_objects(df).collect()}
    assert got["i", 0]["object_id"] == "glass_000001" and got["i", 0]["occupancy"] == 0.25 and not got["i", 0]["touches_border"]
    assert got["i", 1]["error"] == "empty_mask" and got["j", 0]["error"] == "no_pixels" and got["j", 0]["object_id"] is None
    audit = spark.createDataFrame([("o1", 1, "glass", "i", 30, 20, 0.9, mask.tobytes(), mask.tobytes()), ("o2", None, "glass", "i", 3, 2, 1.5, b"\x00\x07", b"\x00\x00")], "object_id string, class_id int, class_name string, source_image string, width int, height int, segmentation_score double, mask binary, alpha binary")
    p = {r["object_id"]: r["problems"] for r in bank.audit_object_bank(audit).collect()}
    assert p["o1"] == [] and p["o2"] == ["mask_not_binary", "mask_all_black", "alpha_empty", "size_mismatch", "score_out_of_range", "missing_class_id"]


def model():
    def found(tensors):
        assert tensors.shape[1:] == (3, 640, 640)
        return [np.array([[320.0, 320.0, 64.0, 64.0, 0.9, 2], [10.0, 10.0, 5.0, 5.0, 0.1, 1]])] * len(tensors)

    return found


def raw_model():
    """Three anchors with two classes; the second overlaps the first, the third is sure of nothing."""

    def found(tensors):
        lift = tensors.mean(axis=(1, 2, 3))
        return [np.array([[320.0, 320.0, 64.0, 64.0, 0.1, 0.8 - 0.1 * v], [322.0, 320.0, 64.0, 64.0, 0.7, 0.2], [100.0, 300.0, 20.0, 20.0, 0.3, 0.1], [50.0, 300.0, 10.0, 10.0, 0.1, 0.2]]) for v in lift]

    return found


def test_scoring_and_decoding(spark):
    rows = [("a", 320, 640, 3, bytes(320 * 640 * 3)), ("b", -1, -1, -1, None), ("c", 2, 2, 3, b"short"), ("d", None, None, None, None)]
    df = spark.createDataFrame(rows, "image_id string, height int, width int, nChannels int, data binary")
    got = scoring.score(df, model).collect()
    assert [(r["image_id"], r["pred_idx"], r["class_id"], r["confidence"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [("a", 0, 2, 0.9, 288.0, 128.0, 352.0, 192.0)]
    frames = df.select(F.lit(7).alias("frame"), "height", "width", "nChannels", "data").limit(1)
    assert len(scoring.score_frames(frames, model).first()["predictions"]) == 1
    raw = spark.createDataFrame([(1, 0, 50.0, 50.0, 20.0, 20.0, [0.1, 0.8], 1.0, 0.0, 0.0, 100, 100), (1, 1, 51.0, 50.0, 20.0, 20.0, [0.7, 0.2], 1.0, 0.0, 0.0, 100, 100), (1, 2, 20.0, 20.0, 10.0, 10.0, [0.1, 0.2], 1.0, 0.0, 0.0, 100, 100)], "image_id long, pred_idx int, cx double, cy double, w double, h double, scores array<double>, ratio double, pad_x double, pad_y double, width int, height int")
    got = scoring.decode(raw).collect()
    assert [(r["pred_idx"], r["class_id"], r["area_ratio"]) for r in got] == [(0, 1, 0.04)]


def test_the_model_gets_batches(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def counted():
        inner = model()

        def found(tensors):
            with open(calls, "a") as f:
                f.write(f"{len(tensors)}\n")
            return inner(tensors)

        return found

    df = spark.createDataFrame([(str(i), 4, 4, 3, bytes(48)) for i in range(10)], "image_id string, height int, width int, nChannels int, data binary").coalesce(1)
    assert scoring.score(df, counted, batch=4).count() == 10
    assert sorted(open(calls).read().split()) == ["2", "4", "4"]


def test_model_input_by_hand():
    """Between the middles of pixels: 0 and 100 over four pixels are 0, 25, 75 and 100; three over two are 1/6 into the border."""
    row = lambda *v: np.repeat(np.array(v, np.uint8)[None, :, None], 3, axis=2)
    assert scoring.resize(row(0, 100), 1, 4)[0, :, 0].tolist() == [0, 25, 75, 100]
    assert scoring.resize(row(0, 60, 120), 1, 2)[0, :, 0].tolist() == [15, 105]
    assert scoring.resize(row(0, 100).transpose(1, 0, 2), 4, 1)[:, 0, 1].tolist() == [0, 25, 75, 100]
    out, ratio, left, top = scoring.letterbox(row(0, 60, 120), 5)
    assert (ratio, left, top) == (5 / 3, 0.0, 1.0) and out[:, 0, 0].tolist() == [114, 0, 0, 114, 114] and out[1, :, 0].tolist() == [0, 24, 60, 96, 120]
    assert scoring.letterbox(row(0, 60, 120), 5, padding="half")[2:] == (0.0, 1.5)
    with pytest.raises(ValueError):
        scoring.letterbox(row(0), 5, padding="other")
    assert scoring.to_tensor(np.array([[[10, 20, 255]]], np.uint8))[:, 0, 0].tolist() == pytest.approx([1.0, 20 / 255, 10 / 255])


def test_embeddings_are_unit_vectors(spark):
    rows = [("a", 2, 2, 3, bytes([0, 0, 255] * 4)), ("b", 2, 2, 3, None), ("c", 2, 2, 3, bytes(12))]
    df = spark.createDataFrame(rows, "object_id string, height int, width int, nChannels int, data binary")
    got = {r["object_id"]: r["embedding"] for r in scoring.embed(df, lambda: lambda t: t.mean(axis=(2, 3)) * 3, size=8).collect()}
    assert got == {"a": [1.0, 0.0, 0.0], "b": None, "c": None}
    index = similarity.build_index(df.select("object_id", F.lit(1).alias("class_id"), F.col("data").alias("crop")).unionByName(df.limit(1).select(F.lit("z").alias("object_id"), F.lit(9).alias("class_id"), F.lit(b"x").alias("crop"))), lambda c: F.when(F.length(c) > 0, F.array(F.length(c).cast("double"), F.lit(1.0))), [1])
    assert sorted((r["object_id"], r["embedding"]) for r in index.collect()) == [("a", [12.0, 1.0]), ("c", [12.0, 1.0])]


def frames_of(n, first=0):
    return [(f"f{i}", 320, 640, 3, bytes([i % 250]) * (320 * 640 * 3)) for i in range(first, first + n)]


def test_decoding_inside_a_row_equals_decoding_by_groups(spark):
    from tessera.streaming import live

    frames = spark.createDataFrame(frames_of(3) + [("none", 5, 5, 3, None)], live.FRAMES)
    scored = scoring.raw_scores(frames, raw_model, 0.25)
    flat = scored.select("image_id", F.explode("raw.rows").alias("r"), "raw.ratio", "raw.pad_x", "raw.pad_y", "width", "height").select("image_id", "r.*", "ratio", "pad_x", "pad_y", "width", "height")
    columns = ["image_id", "pred_idx", "class_id", "confidence", "x1", "y1", "x2", "y2", "area_ratio"]
    inside, grouped = (sorted(map(tuple, df.select(*columns).collect())) for df in (scoring.decode_frames(scored), scoring.decode(flat)))
    assert inside == grouped and [x[:3] for x in inside] == [(f"f{i}", p, c) for i in range(3) for p, c in ((0, 1), (2, 0))]
    assert "Exchange" not in scoring.decode_frames(scored)._jdf.queryExecution().executedPlan().toString()


def test_live_stream(spark, tmp_path):
    from tessera.streaming import live

    rows = [("a", 320, 640, 3, bytes(320 * 640 * 3))]
    spark.createDataFrame(rows, live.FRAMES).write.parquet(f"{tmp_path}/in")
    frames = live.read_frames(spark, f"{tmp_path}/in")
    live.score_stream(frames, model, f"{tmp_path}/out", f"{tmp_path}/ckpt", once=True).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_live_decoding_goes_on_after_a_restart(spark, tmp_path):
    """Two runs, the second after its last batch's commit was lost: that batch is written again, in place of itself."""
    from tessera.streaming import live

    def run():
        frames = live.read_frames(spark, f"{tmp_path}/in", per_trigger=1)
        live.decode_stream(frames, raw_model, f"{tmp_path}/out", f"{tmp_path}/ckpt", once=True).awaitTermination(120)

    spark.createDataFrame(frames_of(2), live.FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame(frames_of(2, 2), live.FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    commits = sorted((p for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    columns = ["image_id", "pred_idx", "class_id", "confidence", "x1", "y1", "x2", "y2"]
    want = scoring.decode_frames(scoring.raw_scores(spark.createDataFrame(frames_of(4), live.FRAMES), raw_model))
    assert sorted(map(tuple, live.read_detections(spark, f"{tmp_path}/out").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_sums_and_percentiles_in_ranges(spark):
    """Few groups over many ranges, so that groups are cut; a null group is one."""
    from tessera.operators import prefix

    r = random.Random(12)
    rows = [(r.choice(["a", "a", "a", "b", None]), round(r.random(), 2)) for _ in range(3000)] + [("one", 4.5)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.createDataFrame(rows, "g string, v double").withColumn("_key", F.struct("g"))
        got = {x["_key"]["g"]: x for x in prefix.percentiles(df, F.col("v"), {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
        steps = df.groupBy("_key", "v").agg(F.count("*").alias("n"))
        ranges = prefix.in_ranges(steps, [F.desc("v")])
        assert ranges.where("_key.g = 'a'").select("_part").distinct().count() >= 3
        sums = prefix.running_sums(ranges, [F.desc("v")], {"upto": "n"})
        found = prefix.later_max(sums, [F.desc("v")], "most", "n").collect()
        stats = {x["g"]: x for x in latency.latency_stats(df.drop("_key"), by=("g",), ms="v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert set(got) == {"a", "b", None, "one"} == set(stats)
    for g in got:
        mine = [v for k, v in rows if k == g]
        want = np.percentile(mine, [0, 50, 95, 100])
        assert np.allclose([got[g][c] for c in ("p0", "p50", "p95", "p100")], want)
        assert stats[g]["n"] == len(mine) and np.allclose([stats[g]["median_ms"], stats[g]["p95_ms"], stats[g]["mean_ms"]], [want[1], want[2], np.mean(mine)])
    for x in found:
        mine = [v for k, v in rows if k == x["_key"]["g"]]
        assert x["upto"] == sum(v >= x["v"] for v in mine)
        assert x["most"] == max(mine.count(v) for v in set(mine) if v <= x["v"])


def test_agreement_by_hand(spark):
    """Image 1: 3 and 2 predictions, 1 match; image 2: one identical pair; image 3: nothing on either side; image 4: one side only."""
    box = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    a = preds(spark, [(1, 0, 0, 0.9, *box(0)), (1, 1, 0, 0.8, *box(100)), (1, 2, 0, 0.7, *box(200)), (2, 0, 1, 0.5, *box(0))])
    b = preds(spark, [(1, 0, 0, 0.8, *box(0)), (1, 1, 0, 0.8, *box(300)), (2, 0, 1, 0.5, *box(0)), (4, 0, 1, 0.5, *box(0))])
    m = matching.match_predictions(a, b)
    images = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id bigint")
    got = latency.agreement_summary(m, a, b, images).first().asDict()
    assert got["match_rate"] == pytest.approx(2 / (2 + 2 + 2)) and (got["unmatched_a"], got["unmatched_b"], got["count_difference"]) == (2, 2, 0)
    assert (got["n_images"], got["exact_images"], got["near_perfect_images"]) == (4, 2, 1) and (got["exact_rate"], got["near_perfect_rate"]) == (0.5, 0.25)
    assert got["avg_iou"] == 1.0 and got["max_conf_diff"] == pytest.approx(0.1) and got["avg_conf_diff"] == pytest.approx(0.05)
    one = latency.agreement_summary(m.where("image_id = 1"), a.where("image_id = 1"), b.where("image_id = 1")).first()
    assert one["match_rate"] == 0.25
    none = latency.agreement_summary(m.where("false"), a.where("false"), b.where("false"), images).first()
    assert (none["match_rate"], none["avg_iou"], none["min_iou"], none["exact_images"]) == (1.0, 0.0, None, 4)


def test_a_removed_pair_is_of_unknown_kind(spark):
    kinds = "gt_class int, pred_class int, count long, mean_iou double, mean_confidence double"
    a = spark.createDataFrame([(0, 1, 4, 0.9, 0.5), (0, 2, 1, 0.9, 0.4)], kinds)
    b = spark.createDataFrame([(0, 2, 3, 0.4, 0.6)], kinds)
    got = {x["pred_class"]: x for x in compare.compare_confusions(a, b).collect()}
    assert (got[1]["kind"], got[1]["status"], got[1]["base_mean_confidence"], got[1]["exp_mean_confidence"]) == ("unknown", "removed_error", 0.5, None)
    assert (got[2]["kind"], got[2]["status"]) == ("localization_dominant", "regressed")


def test_worst_deltas_take_any_sign(spark):
    cmp = spark.createDataFrame([(k, None if k == 3 else v, v) for k, v in enumerate([0.3, -0.2, 0.1, 0.0, 0.5, 0.1, 0.4])], "class_id int, recall_delta double, ap_delta double")
    got = [(x["metric"], x["place"], x["class_id"]) for x in compare.worst_deltas(cmp, ("recall", "ap")).orderBy("metric", "place").collect()]
    assert got == [("ap", i, k) for i, k in enumerate((1, 3, 2, 5, 0), 1)] + [("recall", i, k) for i, k in enumerate((1, 2, 5, 0, 6), 1)]


def test_similarity_report_counts_cases_without_a_margin(spark):
    m = spark.createDataFrame([(0, 1, 1, 0.2), (0, 1, 0, -0.1), (0, 1, None, None), (2, 1, None, None)], "gt_class int, pred_class int, nearest_class int, margin double")
    got = {(x["level"], x["gt_class"]): x for x in similarity.similarity_report(m).collect()}
    pair, alone, whole = got["pair", 0], got["pair", 2], got["overall", None]
    assert (pair["n_cases"], pair["n_margins"], pair["nearest_pred_pct"], pair["avg_margin"], pair["verdict"]) == (3, 2, 33.3333, 0.05, "ambiguous")
    assert (alone["n_cases"], alone["avg_margin"], alone["min_margin"], alone["verdict"]) == (1, 0.0, None, "ambiguous")
    assert (whole["n_cases"], whole["nearest_pred"], whole["nearest_gt"], whole["max_margin"]) == (4, 1, 1, 0.2)
    assert {x["nearest_class"]: x["percentage"] for x in similarity.nearest_classes(m).collect()} == {0: 25.0, 1: 25.0}
    assert similarity.similarity_report(m.where("false")).collect() == []


def test_margin_summary(spark):
    kinds = "case_id int, margin double, pred_class int"
    a = spark.createDataFrame([(1, 0.2, 0), (2, 0.1, 0), (3, -0.3, 1), (9, 0.5, 1)], kinds)
    b = spark.createDataFrame([(1, 0.1, 0), (2, 0.1, 1), (3, 0.0, 1), (8, 0.5, 1)], kinds)
    got = similarity.margin_summary(similarity.compare_margins(a, b)).first()
    assert tuple(got) == (3, 1, 1, 1, 0.0, 0.0667, 0.0667)


def test_mean_ap_needs_all_thresholds(spark):
    p, g = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0)], [(1, 0, 0, 0.0, 0.0, 10.0, 12.0)]
    some = metrics.mean_ap(metrics.detection_metrics(preds(spark, p), gts(spark, g), (0.5, 0.75))).first()
    whole = metrics.mean_ap(metrics.detection_metrics(preds(spark, p), gts(spark, g), metrics.IOUS)).first()
    assert (some["map50"], some["map75"], some["map50_95"]) == (1.0, 1.0, None)
    assert whole["map50_95"] == pytest.approx(0.7)  # an IoU of 5/6 counts at 0.5 to 0.8


def test_candidates_of_all_thresholds_are_one_aggregate(spark):
    plan = metrics.matches_by_threshold(preds(spark, [(1, 0, 0, 0.9, 0.0, 0.0, 1.0, 1.0)]), gts(spark, [(1, 0, 0, 0.0, 0.0, 1.0, 1.0)]), metrics.IOUS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_small_parts_without_a_query(spark):
    """Expressions and joins that no query uses: types of backgrounds, annotations of composed images, criteria, summaries, manifests, orphans."""
    image = lambda v: bytes([v] * 12)
    pasted = image(10)[:3] + bytes([200] * 3) + image(10)[6:]
    made = spark.createDataFrame([("a", pasted, 2, 2, 3, 1, 0, 2, 1), ("b", image(99), 2, 2, 3, 0, 0, 1, 1), ("c", image(99), 2, 2, 3, 0, 0, 1, 1)], "stem string, data binary, height int, width int, nChannels int, x1 int, y1 int, x2 int, y2 int")
    types = bank.background_type(made, spark.createDataFrame([("a", image(11)), ("b", image(10))], "stem string, data binary")).collect()
    assert {r["stem"]: (r["difference"], r["background"]) for r in types} == {"a": (1.0, "train"), "b": (89.0, "external"), "c": (float("inf"), "external")}
    own = spark.createDataFrame([("i1", 2, 0.5, 0.5, 0.1, 0.1)], "image_id string, class_id int, cx double, cy double, w double, h double")
    new = spark.createDataFrame([("n1", 7, 0.2, 0.2, 0.1, 0.1), ("n2", 7, 0.3, 0.3, 0.1, 0.1)], "name string, class_id int, cx double, cy double, w double, h double")
    plan = spark.createDataFrame([("n1", "i1", "train"), ("n2", "i1", "external")], "name string, image_id string, background string")
    assert sorted((r["name"], r["class_id"]) for r in build.composed_annotations(plan, own, new).collect()) == [("n1", 2), ("n1", 7), ("n2", 7)]
    errors.register_criterion("per_image", F.col("count") / F.col("n_images"), True)
    ranked = errors.rank(spark.createDataFrame([(0, 6, 3), (1, 5, 1)], "class_id int, count long, n_images long"), "per_image", ["class_id"], 1)
    assert [r["class_id"] for r in ranked.collect()] == [1]
    cmp = spark.createDataFrame([("improved", 5, 3), ("improved", 2, 1), ("regressed", 1, 4)], "status string, base_count long, exp_count long")
    assert sorted(map(tuple, compare.comparison_summary(cmp).collect())) == [("improved", 2, 7, 4), ("regressed", 1, 1, 4)]
    audited = spark.createDataFrame([(True, 0.5, 1, "a"), (False, 0.9, 3, "b"), (True, 0.8, 2, "c"), (True, 0.5, 4, "d")], "keep boolean, similarity double, matched_test_cases int, object_key string")
    assert [r["object_key"] for r in similarity.audited_manifest(audited).collect()] == ["c", "d", "a"]
    images, labels = (spark.createDataFrame([(x,) for x in v], "stem string") for v in (["a", "b"], ["b", "c"]))
    assert sorted(map(tuple, matching.orphans(images, labels).collect())) == [("a", "image_without_label"), ("c", "label_without_image")]


def test_a_match_shuffles_boxes_once(spark, sf):
    from tessera import fixtures as fx

    m = matching.match_detections(fx.pred(spark, sf), fx.gt(spark, sf))
    plan = m._jdf.queryExecution().sparkPlan().toString() + m._jdf.queryExecution().executedPlan().toString()
    # One for each reading of the boxes, none by image after them, and nothing folds a group to see whether it has rows.
    assert plan.count("Exchange hashpartitioning") == 3 and "Filter (size(concat" not in plan


def test_conflicts_fold_like_the_loop_and_keep_what_is_left(spark):
    r = random.Random(5)
    box = lambda: (lambda x, y: (float(x), float(y), float(x + 10), float(y + 10)))(r.randrange(6), r.randrange(6))
    preds = [(i, k, r.randrange(3), r.random(), *box()) for i in range(12) for k in range(r.randrange(6))]
    gts = [(i, k, r.randrange(3), *box()) for i in range(3, 15) for k in range(r.randrange(6))]
    want = []
    for i in range(15):
        ps, gs, used = sorted((p for p in preds if p[0] == i), key=lambda p: (-p[3], p[1])), [g for g in gts if g[0] == i], set()
        for p in ps:
            def iou(g, p=p):
                inter = max(0.0, min(p[6], g[5]) - max(p[4], g[3])) * max(0.0, min(p[7], g[6]) - max(p[5], g[4]))
                return inter / (200 - inter)
            best = min(((-iou(g), g[1]) for g in gs if g[1] not in used and iou(g) >= 0.5), default=None)
            want.append((i, p[1], best and best[1], "match" if best else "fp", p[4]))
            used |= {best[1]} if best else set()
        want += [(i, None, g[1], "fn", None) for g in gs if g[1] not in used]
    a = spark.createDataFrame(preds, "image_id long, pred_idx long, class_id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(gts, "image_id long, gt_idx long, class_id long, x1 double, y1 double, x2 double, y2 double")
    got = matching.match_detections(a, b, boxes=True).select("image_id", "pred_idx", "gt_idx", "status", "x1").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_focus_classes_reads_its_counts_once(spark):
    seen = spark.sparkContext.accumulator(0)
    tick = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    counts = spark.createDataFrame([(1, 2, 5), (2, 1, 3)], "gt_class long, pred_class long, n long").select("gt_class", "pred_class", tick("n").alias("count"))
    rows = compare.focus_classes(counts, counts.where("gt_class = 9"), [1]).collect()
    assert {(r["direction"], r["base_total"], r["exp_total"]) for r in rows} == {("outgoing", 5, 0), ("incoming", 3, 0)}
    assert seen.value <= 4  # two rows of either side; twice that if each direction made the counts anew


def test_outcomes_give_rates_of_classes(spark):
    m = spark.createDataFrame([("match", 1, 1, 0.9), ("match", 1, 2, 0.6), ("fn", 2, None, None), ("fp", None, 1, None)], "status string, gt_class long, pred_class long, iou double")
    o = errors.outcomes(m)
    assert {(r["status"], r["gt_class"], r["pred_class"]): (r["count"], r["n_iou"], r["high_iou"]) for r in o.collect()}[("match", 1, 1)] == (1, 1, 1)
    assert {r["class_id"]: (r["precision"], r["recall"]) for r in errors.rates(o).collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0)}


def odd_boxes(spark):
    """Images of many overlapping boxes, some with NaN, infinite or null corners and confidences, one without a key."""
    r = random.Random(11)
    odd = lambda v, p=0.04: r.choice([float("nan"), None, float("inf"), -0.0]) if r.random() < p else v
    box = lambda: (lambda x, y: tuple(odd(float(v)) for v in (x, y, x + 10, y + 10)))(r.randrange(6), r.randrange(6))
    image = lambda i: None if i == 14 else i
    p = [(image(i), k, odd(r.randrange(3), 0.1) and 1, odd(r.randrange(1, 4) / 4, 0.1), *box()) for i in range(20) if i % 5 for k in r.sample(range(20), r.randrange(9))]
    g = [(image(i), k, r.choice([0, 1, 2, None]), *box()) for i in range(20) if i % 7 for k in r.sample(range(20), r.randrange(9))]
    return preds(spark, [(*x[:2], r.choice([0, 1, 2, None]), *x[3:]) for x in p]), gts(spark, g)


def test_images_match_as_their_tables(spark):
    from tessera.functions import pairing

    a, b = odd_boxes(spark)
    rows = lambda df: sorted((tuple(map(repr, r)) for r in df.collect()))  # noqa: E731  NaN is like itself
    for order in ("confidence", "input"):
        for least in (0.3, 0.5):
            want = rows(matching.match_detections(a, b, least, order, boxes=True))
            assert rows(matching.match_images(matching.by_image(a, b), least, order, boxes=True)) == want
            assert {s for *_, s, _, _, _, _ in want} == {"'match'", "'fp'", "'fn'"}
    # In small blocks of pairs, some of which part an image's boxes.
    long = lambda df, n: df.withColumn(n, F.col(n).cast("long"))
    lists = matching.by_image(long(a, "pred_idx"), long(b, "gt_idx")).select(F.col("image_id").isNotNull().alias("k"), *[f"preds.{n}" for n in ("pred_idx", "class_id", "x1", "y1", "x2", "y2")], *[F.col(f"gts.{n}").alias(f"g_{n}") for n in ("gt_idx", "class_id", "x1", "y1", "x2", "y2")], "preds.confidence")
    columns = [c.combine_chunks() for c in lists.toArrow().columns]
    whole, before = pairing.paired(0.3, False, True, *columns), pairing.PAIRS
    try:
        for pairing.PAIRS in (1, 5, 40):
            assert str(pairing.paired(0.3, False, True, *columns)) == str(whole)
    finally:
        pairing.PAIRS = before
    with pytest.raises(ValueError, match="order"):
        matching.match_images(matching.by_image(a, b), order="banana")


@pytest.mark.parametrize("name", ["match_detections", "match_input_order", "rank_false_negatives"])
def test_a_query_of_matches_deals_its_boxes_once(spark, sf, name):
    from tessera import queries

    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning(image_id") == 1 and " Join" not in plan and "JoinExec" not in plan and plan.count("ArrowEvalPython") == 1


def test_experiments_match_in_one_pass_as_each_by_itself(spark):
    a, b = odd_boxes(spark)
    images = matching.by_image(a, b).withColumn("preds2", F.reverse(F.filter("preds", lambda p: p["pred_idx"] % 3 > 0)))
    rows = lambda df: sorted(tuple(map(repr, r)) for r in df.collect())
    both = matching.match_experiments(images, boxes=True)
    one = [matching.match_images(images, boxes=True, preds=n) for n in ("preds", "preds2")]
    assert [rows(both.where(F.col("experiment") == n).drop("experiment")) for n in ("preds", "preds2")] == list(map(rows, one))
    x, y = ({(r["status"], r["image_id"]) for r in m.collect()} for m in one)
    got = compare.error_image_list(both).collect()
    keyed = {(r["status"], r["image_id"]): r["side"] for r in got if r["image_id"] is not None}
    assert keyed == {k: "both" if k in x & y else "base_only" if k in x else "exp_only" for k in x | y if k[1] is not None}
    assert sorted((r["status"], r["side"]) for r in got if r["image_id"] is None) == sorted((s, side) for z, side in ((x, "base_only"), (y, "exp_only")) for s, i in z if i is None)


@pytest.mark.parametrize("name", ["error_images", "error_image_list"])
def test_a_comparison_deals_its_boxes_once(spark, sf, name):
    from tessera import queries

    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning(image_id") == 1 and plan.count("Join ") == 0


def test_counts_of_two_experiments_are_made_once(spark, sf):
    from tessera import queries

    for name in ("focus_classes", "compare_false_positives"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" not in plan and "ArrowEvalPython" not in plan  # both sides are the kept counts


def test_steps_of_confidence_count_the_matches_of_each_threshold(spark):
    a, b = odd_boxes(spark)
    a = a.where("confidence IS NOT NULL AND NOT isnan(confidence)")
    images = matching.by_image(a, b).withColumn("preds2", F.filter("preds", lambda p: p["pred_idx"] % 2 > 0))
    steps = metrics.confidence_steps(images, (0.3, 0.6), ("preds", "preds2")).collect()
    for name, some in (("preds", a), ("preds2", a.where("pred_idx % 2 > 0"))):
        want = metrics.matches_by_threshold(some, b, (0.3, 0.6)).groupBy("threshold", "class_id", "confidence").count().collect()
        assert {(s["threshold"], s["class_id"], s["confidence"]): s["hits"] for s in steps if s["experiment"] == name and s["hits"]} == {tuple(w[:3]): w["count"] for w in want}
        for t in (0.3, 0.6):
            mine = [s for s in steps if (s["experiment"], s["threshold"]) == (name, t)]
            assert sum(s["n"] for s in mine) == some.count() and sum(s["boxes"] for s in mine) == b.count()


def test_metrics_of_two_experiments_read_the_boxes_once(spark, sf):
    from tessera import fixtures as fx

    plan = metrics.confidence_steps(fx.images(spark, sf), (0.5, 0.75), ("preds", "preds2"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning(image_id") == 1
    both = metrics.metrics_of_images(fx.images(spark, sf), preds=("preds", "preds2"))
    for name, p in (("preds", fx.pred), ("preds2", fx.pred2)):
        one = metrics.detection_metrics(p(spark, sf), fx.gt(spark, sf))
        got = both.where(F.col("experiment") == name).drop("experiment")
        assert sorted(map(tuple, got.collect())) == [tuple(x if isinstance(x, int) else pytest.approx(x) for x in r) for r in sorted(one.collect())]
