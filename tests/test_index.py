"""The kept vector index: equal to the plain search, on clusters, ties, few objects and empty tables; what it reads and compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index, similarity

OBJECTS, CASES = "object_id long, class_id int, embedding array<double>", "case_id long, gt_class int, pred_class int, embedding array<double>"


def clusters(n=1200, d=8, seed=0):
    r = np.random.default_rng(seed)
    middles = r.standard_normal((12, d))
    x = middles[r.integers(0, 12, n)] + 0.05 * r.standard_normal((n, d))
    x[5::200] = x[4::200]  # equal vectors
    return [(i, int(r.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]


def both(spark, tmp_path, objects, cases, k, **kw):
    a, q = spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(cases, CASES)
    index.write_index(a, f"{tmp_path}/index", 64)
    got = index.search_index(q, f"{tmp_path}/index", k, other_than_self=True, **kw)
    want = similarity.knn(q, a.where("class_id IS NOT NULL"), k, other_than_self=True)
    row = lambda df: sorted((x["case_id"], x["class_id"], x["object_id"], x["similarity"], x["rank"]) for x in df.collect())
    return row(got), row(want)


def test_search_equals_the_plain_search(spark, tmp_path):
    objects = clusters() + [(5000, None, [1.0] * 8), (5001, 1, None), (5002, 7, [1.0] * 8)]
    cases = [(i, c, (c + 1) % 3, v) for i, c, v in clusters()[::40]] + [(9000, 0, 1, None), (9001, 0, 1, [-3.0] * 8)]
    got, want = both(spark, tmp_path, objects, cases, 5)
    assert got == want and {x[1] for x in got} == {0, 1, 2, 7} and not {x[2] for x in got} & {5000, 5001} and 9000 not in {x[0] for x in got}
    some = sorted((x["case_id"], x["class_id"], x["object_id"], x["similarity"], x["rank"]) for x in index.search_index(spark.createDataFrame(cases, CASES), f"{tmp_path}/index", 5, [2, 7], True).collect())
    assert some == [x for x in want if x[1] in (2, 7)]


def test_more_neighbours_than_a_ball_holds(spark, tmp_path):
    objects = clusters(300)
    got, want = both(spark, tmp_path, objects, [(i, c, 0, v) for i, c, v in objects[::60]], 90)
    assert got == want and len(got) > 5 * 90


def test_groups_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_BYTES", 2000)
    objects = clusters(400)
    got, want = both(spark, tmp_path, objects, [(i, c, 0, v) for i, c, v in objects[::7]], 3)
    assert got == want


def test_empty_sides(spark, tmp_path):
    assert both(spark, tmp_path, clusters(50), [], 3) == ([], [])
    assert both(spark, tmp_path, [], [(1, 0, 1, [1.0, 2.0])], 3)[0] == []
    with pytest.raises(Exception, match="no direction"):
        index.write_index(spark.createDataFrame([(1, 0, [0.0, 0.0])], OBJECTS), f"{tmp_path}/zero")


def test_only_folders_of_wanted_classes_and_near_balls_are_met(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.write_index(spark.createDataFrame(clusters(3000), OBJECTS), path, 64)
    plan = index.read_index(spark, path, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "class_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    balls = index.read_index(spark, path)
    i, c, v = clusters(3000)[0]
    (blocks,) = index._groups(spark, spark.createDataFrame([(i, None, v)], "id long, class_id int, embedding array<double>"))
    q = blocks.select("block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("center").alias("q_center"), F.col("radius").alias("q_radius"))
    block = q.first()["block"]
    floors = spark.createDataFrame([(block, k, np.array([0.99]).tobytes(), 0.99) for k in range(3)], "block long, class_id int, floor binary, least double")
    assert 0 < index.near_pairs(balls, q, floors).count() < balls.count() / 3
