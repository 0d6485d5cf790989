"""Readers and writers of images, labels, reports and manifests. All go through Spark's sources, so any store works."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import base_name, safe_double, stem
from tessera.sources.sink import opened, write_files

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
CASE = "struct<image_path:string,gt_class:string,pred_class:string,gt_bbox:array<double>,pred_bbox:array<double>,iou:double,confidence:double>"
REPORT = f"""split string, per_class_metrics map<string,struct<ap:double,precision:double,recall:double>>, class_performance_summary map<string,string>,
  error_analysis struct<confusion:map<string,map<string,struct<count:bigint,mean_iou:double,mean_confidence:double,images:array<string>,cases:array<{CASE}>>>>,
  false_positives:map<string,struct<count:bigint,mean_confidence:double,images:array<string>>>,false_negatives:map<string,struct<count:bigint,images:array<string>>>>"""


def scan_images(spark: SparkSession, path: str, exts: Sequence[str] = IMAGE_EXTENSIONS, recursive: bool = False) -> DataFrame:
    """path, name, stem and size of the images in a folder; contents are not read."""
    either = "{" + ",".join(x for e in exts for x in (e.lower(), e.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", base_name("path").alias("name"), stem("path").alias("stem"), "length").orderBy("path")


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded pixels (BGR bytes); an unreadable image has null data and a size of -1."""
    rows = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return rows.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("nChannels"),
        F.when(F.col("image.height") > 0, F.col("image.data")).alias("data"),
    )


def decoded(path: str) -> Column:
    """A path of ``_metadata``, where Spark encodes it as in a URL, as the store writes it."""
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _label_files(spark: SparkSession, path: str) -> DataFrame:
    """stem and value (the whole text) of label files; names are those of the store, not encoded as in a URL."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path).select(stem(decoded("_metadata.file_name")).alias("stem"), "value")


def read_yolo_labels(spark: SparkSession, path: str, mode: str = "skip_line") -> DataFrame:
    """stem, object_index, class_id, cx, cy, w, h of label files with five tokens a line.

    Lines of another count are skipped.  A line whose tokens are no numbers is skipped alone ('skip_line') or drops
    its whole file ('skip_file').  Class ids may be written as 1 or 1.0.
    """
    if mode not in ("skip_line", "skip_file"):
        raise ValueError("mode must be 'skip_line' or 'skip_file'")
    lines = _label_files(spark, path).select("stem", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    t = F.split(F.trim("line"), r"\s+")
    five = lines.where(F.size(t) == 5).select("stem", "line_no", *[safe_double(F.get(t, F.lit(i))).alias(n) for i, n in enumerate(("class_id", "cx", "cy", "w", "h"))])
    bad = F.col("class_id").isNull() | F.col("cx").isNull() | F.col("cy").isNull() | F.col("w").isNull() | F.col("h").isNull()
    if mode == "skip_file":
        five = five.join(five.where(bad).select("stem").distinct(), "stem", "left_anti")
    good = five.where(~bad)
    # A file is one row of the source, so its lines are few.
    numbered = good.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line_no", "class_id", "cx", "cy", "w", "h"))).alias("rows"))
    return numbered.select("stem", F.posexplode("rows").alias("object_index", "r")).select("stem", "object_index", F.col("r.class_id").cast("int").alias("class_id"), "r.cx", "r.cy", "r.w", "r.h")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no, line of every label line that is not blank, for audits."""
    return _label_files(spark, path).select("stem", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


def load_split(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with their labels by stem; an image without a label is dropped."""
    return images.join(labels, "stem")


def load_dataset(spark: SparkSession, train_root: str, eval_root: str) -> DataFrame:
    """Training images and labels from one root, val and test from another."""
    parts = [("train", train_root), ("val", eval_root), ("test", eval_root)]
    out = None
    for split, root in parts:
        df = load_split(scan_images(spark, f"{root}/{split}/images"), read_yolo_labels(spark, f"{root}/{split}/labels")).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """class_id, class_name of a data.yaml whose names are a list or a map; nc must agree."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # a small file by contract
    return spark.createDataFrame(parse_classes(text), "class_id int, class_name string")


def parse_classes(text: str) -> list[tuple[int, str]]:
    names: list[tuple[int, str]] = []
    nc, inside = None, False
    clean = lambda s: s.strip().strip("'\"")
    for line in text.splitlines():
        body = line.split("#")[0].rstrip()
        if not body.strip():
            continue
        if not body[0].isspace() and not body.startswith("-"):
            key, _, value = body.partition(":")
            inside = key.strip() == "names"
            if key.strip() == "nc":
                nc = int(value)
            elif inside and value.strip().startswith("["):
                names = [(i, clean(v)) for i, v in enumerate(value.strip().strip("[]").split(",")) if clean(v)]
            elif inside and value.strip().startswith("{"):
                names = [(int(k), clean(v)) for k, _, v in (p.partition(":") for p in value.strip().strip("{}").split(","))]
        elif inside:
            item = body.strip()
            if item.startswith("- "):
                names.append((len(names), clean(item[2:])))
            else:
                k, _, v = item.partition(":")
                names.append((int(k), clean(v)))
    if nc is not None and nc != len(names):
        raise ValueError(f"nc is {nc}, but there are {len(names)} names")
    return names


def read_error_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """metrics, confusion, cases, false_positives and false_negatives of a report; missing classes of cases come from the keys."""
    report = spark.read.schema(REPORT).json(path, multiLine=True)
    e = report.select("split", "error_analysis.*", "per_class_metrics")
    conf = e.select("split", F.explode("confusion").alias("gt_class", "m")).select("split", "gt_class", F.explode("m").alias("pred_class", "v"))
    cases = conf.select("split", F.col("gt_class").alias("_g"), F.col("pred_class").alias("_p"), F.explode("v.cases").alias("x"))
    return {
        "metrics": e.select("split", F.explode("per_class_metrics").alias("class_name", "v")).select("split", "class_name", "v.*"),
        "confusion": conf.select("split", "gt_class", "pred_class", "v.count", "v.mean_iou", "v.mean_confidence"),
        "cases": cases.select("split", "x.image_path", F.coalesce("x.gt_class", "_g").alias("gt_class"), F.coalesce("x.pred_class", "_p").alias("pred_class"), "x.gt_bbox", "x.pred_bbox", "x.iou", "x.confidence"),
        "false_positives": e.select("split", F.explode("false_positives").alias("class_name", "v")).select("split", "class_name", "v.count", "v.mean_confidence"),
        "false_negatives": e.select("split", F.explode("false_negatives").alias("class_name", "v")).select("split", "class_name", "v.count"),
    }


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's committer makes the result appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def error_report(split: str, metrics: DataFrame, confusion: DataFrame, cases: DataFrame, false_positives: DataFrame, false_negatives: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """The nested report of a split, as one row in the layout that ``read_error_report`` reads.

    metrics: class_name, ap, precision, recall; confusion: gt_class, pred_class, count, mean_iou, mean_confidence;
    cases: image_path, gt_class, pred_class, gt_bbox, pred_bbox, iou, confidence; false_positives: class_name, count,
    mean_confidence; false_negatives: class_name, count; summary: class_name, text.  Classes and pairs of them are few; their cases
    are as many as a report is meant to list.
    """
    spark = metrics.sparkSession
    pair = ["gt_class", "pred_class"]
    listed = cases.groupBy(*pair).agg(
        F.array_sort(F.collect_set("image_path")).alias("images"),
        F.array_sort(F.collect_list(F.struct("image_path", *pair, "gt_bbox", "pred_bbox", "iou", "confidence"))).alias("cases"),
    )
    entry = F.struct("count", "mean_iou", "mean_confidence", "images", "cases")
    by_gt = confusion.join(listed, pair, "left").groupBy("gt_class").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred_class", entry.alias("v"))))).alias("m"))
    as_map = lambda df, key, *fields: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(*fields).alias("v"))))).alias("m"))
    no_images = F.array().cast("array<string>").alias("images")
    parts = {
        "per_class_metrics": as_map(metrics, "class_name", "ap", "precision", "recall"),
        "confusion": by_gt.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gt_class", F.map_entries("m").alias("e"))))).alias("m")),
        "false_positives": as_map(false_positives, "class_name", "count", "mean_confidence", no_images),
        "false_negatives": as_map(false_negatives, "class_name", "count", no_images),
    }
    parts["confusion"] = parts["confusion"].select(F.transform_values("m", lambda _, e: F.map_from_entries(e)).alias("m"))
    texts = summary if summary is not None else spark.createDataFrame([], "class_name string, text string")
    parts["class_performance_summary"] = texts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "text")))).alias("m"))
    out = spark.range(1).select(F.lit(split).alias("split"))
    for name, df in parts.items():
        out = out.crossJoin(df.withColumnRenamed("m", name))  # one row each
    analysis = F.struct("confusion", "false_positives", "false_negatives").alias("error_analysis")
    return out.select("split", "per_class_metrics", "class_performance_summary", analysis)


def write_error_report(report: DataFrame, path: str) -> None:
    """The report's row as JSON that ``read_error_report`` reads."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_error_reports(reports: DataFrame, path: str) -> int:
    """``<split>.json`` below ``path`` for each report (a row with its split), which ``read_error_report`` reads; how many there are."""
    whole = F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"})
    return write_files(reports.select(F.concat("split", F.lit(".json")).alias("name"), whole.alias("content")), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def label_texts(annotations: DataFrame) -> DataFrame:
    """stem and text of a label file for each image: a line for each object, six decimals."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("class_id"), "cx", "cy", "w", "h")
    lines = annotations.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("object_index", line.alias("line")))).alias("l"))
    return lines.select("stem", F.concat_ws("\n", "l.line").alias("text"))


def write_yolo_labels(annotations: DataFrame, path: str) -> int:
    """``<stem>.txt`` for each image below ``path``, a line for each object with six decimals and a newline at the end; how many there are.

    Tasks write and move the files; a job that fails leaves none (see ``sink.write_files``).
    """
    texts = label_texts(annotations)
    return write_files(texts.select(F.concat("stem", F.lit(".txt")).alias("name"), F.concat("text", F.lit("\n")).alias("content")), path)


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=path.endswith(".json"))  # a file holds one array, a folder a record a line


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest's records as JSON, which ``read_manifest`` reads."""
    manifest.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def manifest_count(manifest: DataFrame) -> int:
    return manifest.count()


def manifest_categories(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def rebuild_object_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each metadata.json below ``path``, in order of object_id."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path)
    rows = rows.select("*", decoded("_metadata.file_path").alias("metadata_path"))
    return rows.orderBy("object_id")


def read_place_list(spark: SparkSession, path: str) -> DataFrame:
    """path, category, label of lines such as ``l/library/indoor/00000001.jpg 212``; other lines are left out."""
    return parse_place_lines(spark.read.text(path))


def parse_place_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    pattern = r"^\s*/?((?:[a-z]/)?(\S+)/[^/\s]+)\s+(\d+)\s*$"
    found = lines.select(F.regexp_extract(col, pattern, 1).alias("path"), F.regexp_extract(col, pattern, 2).alias("category"), F.regexp_extract(col, pattern, 3).alias("_label"))
    return found.where("path <> ''").select("path", "category", F.col("_label").cast("int").alias("label"))


def category_counts(places: DataFrame) -> DataFrame:
    return places.groupBy("category").agg(F.count("*").alias("n"), F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("one_label"))


def ingest_class_folders(files: DataFrame) -> DataFrame:
    """Images of class folders (column path) renumbered as img_%06d in order of class and file name."""
    from tessera.operators.similarity import ranked_objects

    parts = F.split(F.regexp_replace("path", r"\\", "/"), "/")
    rows = files.select("path", F.element_at(parts, -2).alias("class_name"), base_name("path").alias("file"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("ext"))
    r = ranked_objects(rows, [F.col("class_name"), F.col("file"), F.col("path")])
    return r.withColumn("new_name", F.concat(F.format_string("img_%06d", F.col("global_rank")), F.lit("."), F.col("ext"))).drop("global_rank", "ext")


def collect_backgrounds(images: DataFrame, category: str, source: str) -> DataFrame:
    """Metadata rows of images (path, width, height): normalised category, an id from the path, aspect ratio."""
    name = category.strip().lower()
    if not name:
        raise ValueError("a category must not be empty")
    return images.select(
        F.concat(F.lit("bg_"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 12)).alias("background_id"), F.col("path").alias("image_path"), F.lit(name).alias("category"), F.lit(source).alias("source"),
        "width", "height", F.when(F.col("height") > 0, F.round(F.col("width") / F.col("height"), 4)).alias("aspect_ratio"), stem("path").alias("source_id"),
    )


def artifact_info(spark: SparkSession, path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """path, sha256 and size of each file.  Tasks read a file as a stream of chunks, so its size is not bounded by a row's.  Empty files have no row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("path").to_pylist():
                store, at = opened(name)
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(at) as stream:
                    while chunk := stream.read(chunk_bytes):
                        digest.update(chunk)
                        size += len(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()]), pa.array([size])], ["path", "sha256", "size"])

    listed = spark.read.format("binaryFile").load(path).select("path")  # names alone; contents are not read here
    return listed.mapInArrow(work, "path string, sha256 string, size long")
