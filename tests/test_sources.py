"""Round trips of the readers and writers on temporary files."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import build, compare
from tessera.sources import files, sink


def png(width, height, rgb):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(png(4, 3, (10, 20, 30)))
    (tmp_path / "a.JPG").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    assert [r["name"] for r in files.scan_images(spark, str(tmp_path)).collect()] == ["a.JPG", "b.png"]
    got = {r["path"][-5:]: r for r in files.read_images(spark, str(tmp_path / "*.png")).collect()}
    assert (got["b.png"]["width"], got["b.png"]["height"]) == (4, 3) and bytes(got["b.png"]["data"][:3]) == bytes((30, 20, 10))
    info = files.artifact_info(spark, str(tmp_path / "b.png")).first()
    assert info["size"] == len(png(4, 3, (10, 20, 30))) and len(info["sha256"]) == 64


def test_labels(spark, tmp_path):
    d = tmp_path / "labels"
    d.mkdir()
    (d / "a.txt").write_text("0 0.5 0.5 0.25 0.25\n1 0.1 0.1 0.1\n2.0 0.2 0.2 0.1 0.1\n")
    (d / "b.txt").write_text("x 0.5 0.5 0.25 0.25\n1 0.5 0.5 0.25 0.25\n")
    (d / "e.txt").write_text("")
    rows = lambda mode: sorted((r["stem"], r["object_index"], r["class_id"]) for r in files.read_yolo_labels(spark, str(d), mode).collect())
    assert rows("skip_line") == [("a", 0, 0), ("a", 1, 2), ("b", 0, 1)] and rows("skip_file") == [("a", 0, 0), ("a", 1, 2)]
    with pytest.raises(ValueError):
        files.read_yolo_labels(spark, str(d), "other")
    ann = files.read_yolo_labels(spark, str(d))
    files.write_yolo_labels(ann, str(tmp_path / "out"))
    back = files.read_yolo_labels(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ann.collect()))
    assert sorted(f.name for f in (tmp_path / "out").glob("*.txt")) == ["a.txt", "b.txt"] and (tmp_path / "out" / "b.txt").read_text() == "1 0.500000 0.500000 0.250000 0.250000\n"
    assert files.read_label_lines(spark, str(d)).count() == 5
    images = spark.createDataFrame([("a",), ("z",)], "stem string")
    assert files.load_split(images, ann).select("stem").distinct().count() == 1


def test_names_with_spaces_and_marks(spark, tmp_path):
    """A space, a percent sign, one that looks encoded, and letters beyond ASCII, through every step of a data set."""
    stems = ["my img", "50% off", "a%20b", "größe ñ", "plain"]
    for split in ("train", "val", "test"):
        (tmp_path / split / "images").mkdir(parents=True)
        (tmp_path / split / "labels").mkdir()
        for i, s in enumerate(stems):
            (tmp_path / split / "images" / f"{s}.png").write_bytes(png(2, 2, (1, 2, 3)))
            (tmp_path / split / "labels" / f"{s}.txt").write_text(f"{i} 0.5 0.5 0.25 0.25\n")
    images, labels = files.scan_images(spark, str(tmp_path / "train/images")), files.read_yolo_labels(spark, str(tmp_path / "train/labels"))
    assert sorted(r["stem"] for r in images.collect()) == sorted(r["stem"] for r in labels.collect()) == sorted(stems)
    assert files.load_split(images, labels).count() == 5
    whole = files.load_dataset(spark, str(tmp_path), str(tmp_path))
    assert sorted((r["split"], r["stem"]) for r in whole.collect()) == sorted((x, s) for x in ("train", "val", "test") for s in stems)
    files.write_yolo_labels(labels, str(tmp_path / "out"))
    assert sorted(f.stem for f in (tmp_path / "out").glob("*.txt")) == sorted(stems)
    assert sorted(map(tuple, files.read_yolo_labels(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, labels.collect()))
    lines = files.read_label_lines(spark, str(tmp_path / "train/labels"))
    with_split = lambda df: df.select(F.lit("train").alias("split"), "stem").distinct()
    assert build.audit_structure(with_split(images), with_split(lines), ["train"]).collect() == []


def test_classes(spark, tmp_path):
    assert files.parse_classes("nc: 2\nnames: ['x', 'y']\n") == files.parse_classes("names:\n  0: x\n  1: y\nnc: 2\n") == files.parse_classes("names:\n- x\n- y\n") == [(0, "x"), (1, "y")]
    with pytest.raises(ValueError):
        files.parse_classes("nc: 3\nnames: [x, y]\n")
    (tmp_path / "data.yaml").write_text("train: images\nnames: {0: x, 1: y}\n")
    assert files.read_classes(spark, str(tmp_path / "data.yaml")).count() == 2


def test_reports(spark, tmp_path):
    report = {
        "split": "val", "per_class_metrics": {"metal": {"ap": 0.8, "precision": 0.7, "recall": 0.9}}, "class_performance_summary": {},
        "error_analysis": {"confusion": {"metal": {"glass": {"count": 23, "mean_iou": 0.9, "mean_confidence": 0.5, "images": ["a"], "cases": [{"image_path": "a", "iou": 0.9}]}}}, "false_positives": {"glass": {"count": 10, "mean_confidence": 0.4}}, "false_negatives": {"plastic": {"count": 8}}},
    }
    (tmp_path / "report.json").write_text(json.dumps(report, indent=1))
    got = files.read_error_report(spark, str(tmp_path / "report.json"))
    assert got["confusion"].first()["count"] == 23 and got["false_positives"].first()["count"] == 10 and got["false_negatives"].first()["count"] == 8
    assert tuple(got["cases"].select("gt_class", "pred_class").first()) == ("metal", "glass")
    files.write_report(got["confusion"], str(tmp_path / "out.json"))
    files.write_csv(got["confusion"], str(tmp_path / "out.csv"))
    assert spark.read.json(str(tmp_path / "out.json")).count() == spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == 1


def test_manifests_and_places(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"image_path": "a", "category": "library"}, {"image_path": "b", "category": "library"}, {"image_path": "c", "category": None}]))
    got = {r["category"]: r["n"] for r in files.manifest_categories(files.read_manifest(spark, str(tmp_path / "m.json"))).collect()}
    assert got == {"library": 2, "unknown": 1}
    for i in (2, 1):
        (tmp_path / f"o{i}").mkdir()
        (tmp_path / f"o{i}" / "metadata.json").write_text(json.dumps({"object_id": f"x{i}"}))
    assert [r["object_id"] for r in files.rebuild_object_manifest(spark, str(tmp_path)).collect()] == ["x1", "x2"]
    lines = spark.createDataFrame([("l/library/indoor/00000001.jpg 212",), ("l/library/indoor/00000002.jpg 212",), ("no line",)], "value string")
    places = files.parse_place_lines(lines)
    assert [tuple(r) for r in places.select("category", "label").distinct().collect()] == [("library/indoor", 212)]
    assert files.category_counts(places).first()["one_label"]
    folders = spark.createDataFrame([("d/glass/b.jpg",), ("d/glass/a.jpg",), ("d/can/z.png",)], "path string")
    assert sorted(map(tuple, files.ingest_class_folders(folders).select("path", "new_name").collect())) == [("d/can/z.png", "img_000001.png"), ("d/glass/a.jpg", "img_000002.jpg"), ("d/glass/b.jpg", "img_000003.jpg")]
    bg = files.collect_backgrounds(spark.createDataFrame([("x/a.jpg", 8, 6)], "path string, width int, height int"), " Library ", "web").first()
    assert bg["background_id"].startswith("bg_") and len(bg["background_id"]) == 15 and bg["category"] == "library"
    with pytest.raises(ValueError):
        files.collect_backgrounds(folders, "  ", "web")


def test_ten_thousand_files_and_none_of_a_failed_job(spark, tmp_path):
    """Files are written and moved by tasks; a name that comes twice, or leads out of the folder, undoes the job."""
    rows = spark.range(10_000).select(F.concat(F.lit("a b/"), F.col("id") % 7, F.lit("/%"), "id", F.lit(".txt")).alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("é"), "id")).alias("content"))
    assert sink.write_files(rows, str(tmp_path / "out")) == 10_000
    found = [f for f in (tmp_path / "out").rglob("*") if f.is_file()]
    assert len(found) == 10_000 and (tmp_path / "out/a b/1/%8.txt").read_text() == "é8" and (tmp_path / "out/a b/0/%0.txt").read_text() == ""
    again = spark.createDataFrame([("a b/1/%8.txt", b"new"), ("other", b"")], "name string, content binary")
    assert sink.write_files(again, f"file://{tmp_path}/out") == 2 and (tmp_path / "out/a b/1/%8.txt").read_bytes() == b"new"
    for bad in ("x5", "../x", None):
        with pytest.raises(Exception, match="comes twice|not the path"):
            sink.write_files(spark.range(50).select(F.concat(F.lit("x"), "id").alias("name"), F.lit("v").alias("content")).unionByName(spark.createDataFrame([(bad, "v")], "name string, content string")), str(tmp_path / "bad"))
    assert not [f for f in (tmp_path / "bad").rglob("*")]
    assert sink.write_files(again.where("false"), str(tmp_path / "none")) == 0


def test_error_reports(spark, tmp_path):
    """A report that is built, written and read again; one file for each split."""
    metrics = spark.createDataFrame([("metal", 0.8, 0.7, 0.9)], "class_name string, ap double, precision double, recall double")
    confusion = spark.createDataFrame([("metal", "glass", 2, 0.9, 0.5)], "gt_class string, pred_class string, count long, mean_iou double, mean_confidence double")
    cases = spark.createDataFrame([("a", "metal", "glass", [1.0, 2.0, 3.0, 4.0], None, 0.9, 0.5), ("b", "metal", "glass", None, None, 0.8, None)], "image_path string, gt_class string, pred_class string, gt_bbox array<double>, pred_bbox array<double>, iou double, confidence double")
    fp = spark.createDataFrame([("glass", 10, 0.4)], "class_name string, count long, mean_confidence double")
    fn = spark.createDataFrame([("plastic", 8)], "class_name string, count long")
    summary = spark.createDataFrame([("metal", "good")], "class_name string, text string")
    report = files.error_report("val", metrics, confusion, cases, fp, fn, summary)
    assert compare.check_report(report).first()["problems"] == []
    files.write_error_report(report, str(tmp_path / "folder"))
    assert files.write_error_reports(report.unionByName(files.error_report("test", metrics, confusion, cases, fp, fn)), str(tmp_path / "each")) == 2
    assert sorted(f.name for f in (tmp_path / "each").iterdir()) == ["test.json", "val.json"]
    for path in ("folder", "each/val.json"):
        got = files.read_error_report(spark, str(tmp_path / path))
        assert [tuple(r) for r in got["metrics"].collect()] == [("val", "metal", 0.8, 0.7, 0.9)]
        assert [tuple(r) for r in got["confusion"].collect()] == [("val", "metal", "glass", 2, 0.9, 0.5)]
        assert sorted((r["image_path"], r["gt_class"], r["gt_bbox"], r["iou"]) for r in got["cases"].collect()) == [("a", "metal", [1.0, 2.0, 3.0, 4.0], 0.9), ("b", "metal", None, 0.8)]
        assert got["false_positives"].first()["count"] == 10 and got["false_negatives"].first()["class_name"] == "plastic"
    manifest = spark.createDataFrame([("a", None), ("b", "x")], "image_path string, category string")
    files.write_manifest(manifest, str(tmp_path / "manifest"))
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "manifest")).select("image_path", "category").collect()), key=repr) == [("a", None), ("b", "x")]
    assert files.manifest_count(manifest) == 2


def test_fingerprints_read_chunks(spark, tmp_path):
    """Files of many chunks, of exactly one, and of less; names that need encoding in a URL. Empty files have no row."""
    (tmp_path / "empty.bin").write_bytes(b"")
    data = {"big %.bin": bytes(range(256)) * 5000, "one.bin": b"x" * 1000, "small ü.bin": b"x"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    info = files.artifact_info(spark, str(tmp_path), chunk_bytes=1000)
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["size"]) for r in info.collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in data.items()}
    assert "content" not in info._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
