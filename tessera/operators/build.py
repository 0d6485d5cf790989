"""Plans and audits of training sets; pixels are touched only where an operator says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import area_bucket, generation_count, images_with_class
from tessera.operators.bank import area_matrix
from tessera.operators.prefix import numbered
from tessera.operators.sampling import balanced_sample, uniform


def targeted_set(train: DataFrame, annotations: DataFrame, classes: Sequence[int], suffix: str = "_e2") -> DataFrame:
    """All training samples, and a copy of each image that contains one of the classes."""
    chosen = train.join(images_with_class(annotations, classes), "image_id", "left_semi")
    originals = train.select("image_id", F.col("stem"), F.lit("original").alias("kind"))
    return originals.unionByName(chosen.select("image_id", F.concat("stem", F.lit(suffix)).alias("stem"), F.lit("augmented").alias("kind")))


def transform_boxes(annotations: DataFrame, flip: bool = False, scale: float = 1.0, least_visible: float = 0.2) -> DataFrame:
    """Normalised boxes (cx, cy, w, h) after a flip and a scale about the middle, clipped; those hardly visible go."""
    cx = F.lit(1.0) - F.col("cx") if flip else F.col("cx")
    cx, cy = (cx - 0.5) * scale + 0.5, (F.col("cy") - 0.5) * scale + 0.5
    w, h = F.col("w") * scale, F.col("h") * scale
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x1, y1, x2, y2 = clip(cx - w / 2), clip(cy - h / 2), clip(cx + w / 2), clip(cy + h / 2)
    visible = F.when(w * h > 0, (x2 - x1) * (y2 - y1) / (w * h)).otherwise(F.lit(0.0))
    kept = annotations.withColumns({"_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2, "_v": visible}).where(F.col("_v") >= least_visible)
    return kept.withColumns({
        "cx": (F.col("_x1") + F.col("_x2")) / 2, "cy": (F.col("_y1") + F.col("_y2")) / 2, "w": F.col("_x2") - F.col("_x1"), "h": F.col("_y2") - F.col("_y1"),
    }).drop("_x1", "_y1", "_x2", "_y2", "_v")


def extract_objects(annotated: DataFrame) -> DataFrame:
    """Objects of images (pixels, an int box and a mask of the image's size): crop, occupancy, border contact, ids class_%06d.

    A box without pixels or mask is a row with an error instead of an exception.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                area = max(0, (r.x2 - r.x1) * (r.y2 - r.y1))
                if r.data is None or r.mask is None or not area or len(r.mask) != r.height * r.width:
                    rows.append((r.image_id, r.object_index, r.class_name, None, 0, area, None, None, "no_pixels"))
                    continue
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[r.y1 : r.y2, r.x1 : r.x2]
                mask = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)[r.y1 : r.y2, r.x1 : r.x2]
                inside = int((mask > 127).sum())
                border = r.x1 <= 0 or r.y1 <= 0 or r.x2 >= r.width or r.y2 >= r.height
                rows.append((r.image_id, r.object_index, r.class_name, image.tobytes(), inside, area, round(inside / area, 4), border, None if inside else "empty_mask"))
            yield pd.DataFrame(rows, columns=["image_id", "object_index", "class_name", "crop", "mask_area", "bbox_area", "occupancy", "touches_border", "error"])

    schema = "image_id string, object_index int, class_name string, crop binary, mask_area long, bbox_area long, occupancy double, touches_border boolean, error string"
    out = annotated.select("image_id", "object_index", "class_name", "height", "width", "x1", "y1", "x2", "y2", "data", "mask").mapInPandas(work, schema)
    # Numbers come from keys alone, so pixels are not sorted by class.
    keys = out.where("error IS NULL").select("image_id", "object_index", "class_name")
    named = numbered(keys, ["class_name"], ["image_id", "object_index"], "_n").select("image_id", "object_index", F.format_string("%s_%06d", "class_name", "_n").alias("object_id"))
    return out.join(named, ["image_id", "object_index"], "left")


def check_metadata(objects: DataFrame) -> DataFrame:
    """Integrity rules of object metadata, as a list of problems; a missing value breaks its rule.

    Columns: object_id, split, class_id, class_name, image_width, image_height, x1, y1, x2, y2, crop_width,
    crop_height, segmentation_score, mask_area, bbox_area, occupancy.
    """
    holds = lambda rule: F.coalesce(rule, F.lit(False))
    v = F.col
    rules = [
        ("empty_object_id", v("object_id") != ""), ("not_train_split", v("split") == "train"), ("negative_class_id", v("class_id") >= 0), ("empty_class_name", v("class_name") != ""),
        ("invalid_image_dimensions", (v("image_width") > 0) & (v("image_height") > 0)),
        ("bbox_outside_image", (v("x1") >= 0) & (v("y1") >= 0) & (v("x2") <= v("image_width")) & (v("y2") <= v("image_height"))),
        ("invalid_bbox_dimensions", (v("x2") > v("x1")) & (v("y2") > v("y1"))),
        ("crop_size_mismatch", (v("crop_width") == v("x2") - v("x1")) & (v("crop_height") == v("y2") - v("y1"))),
        ("segmentation_score_out_of_range", v("segmentation_score").between(0, 1)), ("empty_mask", v("mask_area") > 0), ("invalid_bbox_area", v("bbox_area") > 0),
        ("occupancy_out_of_range", v("occupancy").between(0, 1)),
    ]
    return objects.withColumn("problems", F.array_compact(F.array(*[F.when(~holds(rule), name) for name, rule in rules])))


def object_pool(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose object file exists."""
    return manifest.join(files.select(F.col("path").alias("object_path")), "object_path", "left_semi")


#: A sampler takes a pool of objects, a number of draws and a seed, and gives rows of the pool with ``draw`` from 0 on.
Sampler = Callable[[DataFrame, int, int], DataFrame]
#: A strategy gives the number of images to make of an object, and the bucket it is counted under, from the object's row.
Strategy = Callable[[], tuple[Column, Column]]


def by_area(counts: tuple[int, int, int] = (3, 2, 1), small: float = 0.05, medium: float = 0.20) -> Strategy:
    """More images of objects that fill less of their image (area_ratio); thresholds are 0 < small < medium < 1."""
    if not 0 < small < medium < 1:
        raise ValueError("thresholds must satisfy 0 < small < medium < 1")
    ratio = "area_ratio"
    return lambda: (generation_count(F.col(ratio), counts, small, medium), area_bucket(F.col(ratio), small, medium))


def by_column(count: str, bucket: str, most: int = 10) -> Strategy:
    """As many images as a column says, at most ``most``; null makes none."""
    return lambda: (F.least(F.coalesce(F.col(count).cast("int"), F.lit(0)), F.lit(most)), F.col(bucket))


def plan_composition(backgrounds: DataFrame, pool: DataFrame, seed: int, sampler: Sampler = balanced_sample, strategy: Strategy | None = None) -> DataFrame:
    """For each background in order of id one object that the sampler draws, and a row for each image to generate.

    ``sampler`` and ``strategy`` are the caller's to choose: the first draws as many objects as there are backgrounds,
    the second says how many images each makes (none: the background has no row).
    """
    from tessera.operators.similarity import ranked_objects

    n = backgrounds.count()
    placed = ranked_objects(backgrounds, [F.col("background_id")]).withColumn("draw", F.col("global_rank") - 1).drop("global_rank")
    drawn = sampler(pool, n, seed)
    count, bucket = (strategy or by_area())()
    planned = placed.join(drawn, "draw").withColumns({"bucket": bucket, "_count": count}).where("_count > 0")
    each = planned.withColumn("generation", F.explode(F.sequence(F.lit(1), F.col("_count")))).drop("_count")
    return each.withColumn("name", F.concat_ws("_", F.col("background_id").cast("string"), F.lit("e7"), F.col("generation").cast("string"), F.col("object_id").cast("string")))


def place(plan: DataFrame, seed: int, low: float = 0.10, high: float = 0.35, fit: bool = True) -> DataFrame:
    """Size and place of the object: a height of U(low, high) of the background, the aspect kept, anywhere inside.

    Columns width, height (background) and object_width, object_height are read.  ``fit`` shrinks what is too wide.
    """
    h = uniform(seed, F.lit("scale"), "name") * (high - low) + low
    height = F.greatest(F.lit(1.0), F.floor(h * F.col("height")))
    width = height * F.col("object_width") / F.col("object_height")
    if fit:
        shrink = F.least(F.lit(1.0), F.col("width") / width)
        height, width = height * shrink, width * shrink
    out = plan.withColumn("place_w", F.greatest(F.lit(1), F.floor(width).cast("int"))).withColumn("place_h", F.greatest(F.lit(1), F.floor(height).cast("int")))
    at = lambda name, room: F.floor(uniform(seed, F.lit(name), "name") * (F.greatest(F.lit(0), room) + 1)).cast("int")
    return out.withColumn("place_x", at("x", F.col("width") - F.col("place_w"))).withColumn("place_y", at("y", F.col("height") - F.col("place_h")))


def resize_area(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bytes (height, width, channels) resampled by the area that each new pixel covers, rounded."""
    if x.shape[:2] == (h, w):
        return x
    out = np.einsum("yi,ijc,xj->yxc", area_matrix(x.shape[0], h), x.astype(float), area_matrix(x.shape[1], w), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def scene_light(background: np.ndarray) -> float:
    """Mean luminance of a BGR image, in whole steps for each pixel, where 127.5 is 1."""
    b, g, r = (background[:, :, k].astype(np.int64) for k in range(3))
    grey = (1868 * b + 9617 * g + 4899 * r + (1 << 13)) >> 14  # fixed values: the shares of blue, green and red in 1 / 16384
    return float(grey.mean() / 127.5)


def transformed(rgba: np.ndarray, light: float, temperature: int = 0, occlusion: float = 0.0, reflection: float = 0.0) -> np.ndarray:
    """An object (BGRA bytes) in the scene's light: a shift from red to blue, a highlight that fades from left to right, a hidden bottom.

    Each step is cut off to whole values of 0 to 255.  Colours change where the object is transparent, too; only alpha
    decides what is seen.
    """
    whole = lambda v: np.clip(v, 0, 255).astype(np.uint8)
    out = rgba.copy()
    out[:, :, :3] = whole(out[:, :, :3].astype(np.float32) * np.float32(light))
    out[:, :, :3] = whole(out[:, :, :3].astype(np.float32) + np.array([temperature, 0, -temperature], np.float32))
    if reflection > 0:
        highlight = np.linspace(1.0, 0.0, rgba.shape[1])[None, :, None] * 255 * reflection
        out[:, :, :3] = whole(out[:, :, :3].astype(np.float32) + highlight.astype(np.float32))
    if occlusion > 0:
        hidden = int(rgba.shape[0] * occlusion)
        out[rgba.shape[0] - hidden :, :, 3] = 0
    return out


def compose_one(background: np.ndarray, rgba: np.ndarray, x: int, y: int, h: int, w: int, temperature: int = 0, occlusion: float = 0.0, reflection: float = 0.0) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int] | None]:
    """Blend an object (BGRA) onto a background (BGR) at (x, y): the image, the object's mask (h, w; 0 or 255) and the box of what is seen.

    The object is transformed at its own size and then shrunk by areas, alpha too; every pixel with some alpha is part of
    the mask.  A place that leads out of the background is an error.
    """
    if x < 0 or y < 0 or x + w > background.shape[1] or y + h > background.shape[0]:
        raise ValueError("the object's place leads out of the background")
    obj = resize_area(transformed(rgba, scene_light(background), temperature, occlusion, reflection), h, w)
    alpha = obj[:, :, 3:].astype(np.float32) / np.float32(255)
    out = background.copy()
    region = out[y : y + h, x : x + w]
    region[:] = np.clip(obj[:, :, :3].astype(np.float32) * alpha + region.astype(np.float32) * (1 - alpha), 0, 255).astype(np.uint8)
    mask = np.where(obj[:, :, 3] > 0, 255, 0).astype(np.uint8)
    ys, xs = np.nonzero(mask)
    return out, mask, (int(xs.min()) + x, int(ys.min()) + y, int(xs.max()) + x + 1, int(ys.max()) + y + 1) if len(xs) else None


def compose(plan: DataFrame, images: DataFrame, objects: DataFrame, seed: int, warmth: int = 20, reflection: float = 0.25, occlude: bool = True) -> DataFrame:
    """name, data, mask, box of each planned image; failures are rows with an error.

    Plan columns: name, background_id, object_id, place_*.  Pixels are joined last: images (background_id, height,
    width, data in BGR) and objects (object_id, object_height, object_width, rgba in BGRA).  The shift of colour is a whole
    number of -warmth to warmth, the hidden share of the bottom 0.10 to 0.35, both drawn by name.
    """
    j = plan.join(images.select("background_id", F.col("height").alias("_h"), F.col("width").alias("_w"), "data"), "background_id")
    j = j.join(objects.select("object_id", F.col("object_height").alias("_oh"), F.col("object_width").alias("_ow"), "rgba"), "object_id")
    j = j.select("name", "_h", "_w", "data", "_oh", "_ow", "rgba", "place_x", "place_y", "place_w", "place_h",
                 (F.floor(uniform(seed, F.lit("warm"), "name") * (2 * warmth + 1)) - warmth).cast("int").alias("_warm"), (uniform(seed, F.lit("hide"), "name") * 0.25 + 0.10).alias("_hide"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                try:
                    bg = np.frombuffer(r["data"], np.uint8).reshape(r["_h"], r["_w"], 3)
                    obj = np.frombuffer(r["rgba"], np.uint8).reshape(r["_oh"], r["_ow"], 4)
                    out, mask, box = compose_one(bg, obj, r["place_x"], r["place_y"], r["place_h"], r["place_w"], r["_warm"], r["_hide"] if occlude else 0.0, reflection)
                    rows.append((r["name"], out.tobytes(), mask.tobytes(), list(box) if box else None, None if box else "nothing_visible"))
                except (ValueError, TypeError) as e:
                    rows.append((r["name"], None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["name", "data", "mask", "box", "error"])

    return j.mapInPandas(work, "name string, data binary, mask binary, box array<int>, error string")


def choose_background(plan: DataFrame, seed: int, external: float = 0.5) -> DataFrame:
    """external or train background for each planned image."""
    return plan.withColumn("background", F.when(uniform(seed, F.lit("background"), "name") < external, "external").otherwise("train"))


def composed_annotations(plan: DataFrame, originals: DataFrame, new: DataFrame) -> DataFrame:
    """Labels of composed images: the new object, and on train backgrounds the image's own objects."""
    own = plan.where("background = 'train'").select("name", "image_id").join(originals, "image_id").drop("image_id")
    return own.select("name", "class_id", "cx", "cy", "w", "h").unionByName(new.select("name", "class_id", "cx", "cy", "w", "h"))


def finalise(samples: DataFrame, augmented: DataFrame, annotations: DataFrame) -> DataFrame:
    """Both sets without repeated names and without samples that have no label."""
    from tessera.operators.compare import merge_samples

    return merge_samples(samples, augmented).join(annotations.select("name").distinct(), "name", "left_semi")


def build_counts() -> dict[str, Column]:
    """What a build counts of its samples (kind)."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    return {"original_images": kind("original"), "synthetic_images": kind("synthetic"), "failures": kind("failed")}


def extraction_counts() -> dict[str, Column]:
    """What is counted of extracted objects (error): all, extracted, failed, and failed for each reason."""
    failed = lambda e: F.count_if(F.col("error") == e)
    return {"objects": F.count(F.lit(1)), "extracted": F.count_if(F.col("error").isNull()), "failures": F.count_if(F.col("error").isNotNull()), "no_pixels": failed("no_pixels"), "empty_mask": failed("empty_mask")}


def build_summary(samples: DataFrame) -> DataFrame:
    """Sources and counts of a build's samples; while they are written, ``jobs.write_counted`` takes the counts with them."""
    return samples.agg(F.countDistinct("source").alias("source_images"), *[v.alias(n) for n, v in build_counts().items()])


def audit_structure(images: DataFrame, labels: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """problem, split, stem: missing splits, orphans of both sides, repeated stems (columns split, stem)."""
    keys = ["split", "stem"]
    a = images.join(labels.select(*keys).distinct(), keys, "left_anti").select(F.lit("image_without_label").alias("problem"), *keys)
    b = labels.join(images.select(*keys).distinct(), keys, "left_anti").select(F.lit("label_without_image").alias("problem"), *keys)
    c = images.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_stem").alias("problem"), *keys)
    wanted = images.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    d = wanted.join(images.select("split").distinct(), "split", "left_anti").select(F.lit("missing_split").alias("problem"), "split", F.lit(None).cast("string").alias("stem"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def audit_labels(lines: DataFrame, n_classes: int, slack: float = 1e-5) -> DataFrame:
    """The first problem of each label line: token_count, not_numeric, class_range, center_range, size_range, outside; null if sound."""
    t = F.split(F.trim("line"), r"\s+")
    v = F.transform(t, lambda x: x.try_cast("double"))
    n = lines.withColumn("_t", t).withColumn("_v", v)
    g = lambda i: F.get("_v", F.lit(i))
    outside = (g(1) - g(3) / 2 < -slack) | (g(1) + g(3) / 2 > 1 + slack) | (g(2) - g(4) / 2 < -slack) | (g(2) + g(4) / 2 > 1 + slack)
    problem = (
        F.when(F.size("_t") != 5, "token_count").when(F.exists("_v", lambda x: x.isNull() | F.isnan(x)), "not_numeric")
        .when((g(0) < 0) | (g(0) >= n_classes) | (g(0) != F.floor(g(0))), "class_range").when(~g(1).between(0, 1) | ~g(2).between(0, 1), "center_range")
        .when((g(3) <= 0) | (g(3) > 1) | (g(4) <= 0) | (g(4) > 1), "size_range").when(outside, "outside")
    )
    return n.withColumn("problem", problem).drop("_t", "_v")


def audit_oversample(source: DataFrame, output: DataFrame, expected: DataFrame) -> DataFrame:
    """problem, name, detail of an oversampled set.

    source: stem, label_hash; output: stem, source_stem, kind, label_hash; expected: source_stem, copies.
    """
    originals = output.where("kind = 'original'")
    lost = source.join(originals.select("stem"), "stem", "left_anti").select(F.lit("original_missing").alias("problem"), F.col("stem").alias("name"), F.lit(None).cast("string").alias("detail"))
    src = source.select(F.col("stem").alias("source_stem"), F.col("label_hash").alias("_want"))
    differs = output.join(src, "source_stem").where(~F.col("label_hash").eqNullSafe(F.col("_want"))).select(F.lit("label_differs").alias("problem"), F.col("stem").alias("name"), F.lit(None).cast("string").alias("detail"))
    unknown = output.join(src, "source_stem", "left_anti").select(F.lit("unknown_source").alias("problem"), F.col("stem").alias("name"), F.lit(None).cast("string").alias("detail"))
    actual = output.where("kind = 'copy'").groupBy("source_stem").agg(F.count("*").alias("actual"))
    counts = expected.join(actual, "source_stem", "full_outer").fillna(0, ["copies", "actual"]).where("copies <> actual")
    wrong = counts.select(F.lit("copy_count").alias("problem"), F.col("source_stem").alias("name"), F.concat_ws("/", F.col("actual").cast("string"), F.col("copies").cast("string")).alias("detail"))
    return lost.unionByName(differs).unionByName(unknown).unionByName(wrong)


def oversample_totals(output: DataFrame) -> DataFrame:
    """Originals, copies and samples of an oversampled set, and whether they add up."""
    out = output.agg(F.count_if(F.col("kind") == "original").alias("originals"), F.count_if(F.col("kind") == "copy").alias("copies"), F.count("*").alias("samples"))
    return out.withColumn("adds_up", F.col("originals") + F.col("copies") == F.col("samples"))


def copy_frequency(output: DataFrame) -> DataFrame:
    """How many sources have how many copies."""
    n = output.where("kind = 'copy'").groupBy("source_stem").agg(F.count("*").alias("copies"))
    return n.groupBy("copies").agg(F.count("*").alias("sources"))


def copy_classes(output: DataFrame, classes: DataFrame) -> DataFrame:
    """Copies of each class (source_stem, class_id of the selected objects)."""
    return output.where("kind = 'copy'").join(classes, "source_stem").groupBy("class_id").agg(F.count("*").alias("copies"), F.countDistinct("source_stem").alias("sources"))


def reconcile(summary: DataFrame, samples: DataFrame) -> DataFrame:
    """Whether a build's summary row (images, labels, originals, synthetic, objects) agrees with itself and its samples."""
    n = samples.agg(F.count("*").alias("n_samples"), F.count_if(F.col("kind") == "synthetic").alias("n_synthetic"))
    j = summary.crossJoin(n)  # one row each
    return j.select(
        (F.col("images") == F.col("labels")).alias("images_equal_labels"), (F.col("images") == F.col("originals") + F.col("synthetic")).alias("images_equal_parts"),
        (F.col("synthetic") == F.col("objects")).alias("synthetic_equal_objects"), (F.col("n_samples") == F.col("images")).alias("samples_equal_images"), (F.col("n_synthetic") == F.col("synthetic")).alias("samples_equal_synthetic"),
    )


def leakage(train_output: DataFrame, held_out: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows of a training output that belong to a held-out split; must be empty."""
    return train_output.join(held_out.select(key).distinct(), key, "left_semi")
