"""Box geometry, labels and paths as pure column expressions; they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def c(x: str | Column | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def box_cols(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def yolo_to_xyxy(cx, cy, w, h, width, height) -> Box:
    """Normalised centre and size to pixel corners, as doubles."""
    cx, cy, w, h, width, height = map(c, (cx, cy, w, h, width, height))
    half_w, half_h = w * width / 2, h * height / 2
    return cx * width - half_w, cy * height - half_h, cx * width + half_w, cy * height + half_h


def yolo_to_int_box(cx, cy, w, h, width, height) -> Box:
    """Pixel corners cut towards zero; x1 in [0, W - 1], x2 in [x1 + 1, W], and so for y."""
    x1, y1, x2, y2 = (v.cast("int") for v in yolo_to_xyxy(cx, cy, w, h, width, height))
    width, height = c(width), c(height)
    x1, y1 = F.greatest(F.lit(0), F.least(x1, width - 1)), F.greatest(F.lit(0), F.least(y1, height - 1))
    return x1, y1, F.greatest(x1 + 1, F.least(x2, width)), F.greatest(y1 + 1, F.least(y2, height))


def clip_crop(box: Box, width, height) -> Column:
    """A crop inside the image as a struct of ints, null if nothing is left."""
    width, height = c(width), c(height)
    x1, y1, x2, y2 = (v.cast("int") for v in box)
    x1, y1 = F.greatest(F.lit(0), F.least(x1, width - 1)), F.greatest(F.lit(0), F.least(y1, height - 1))
    x2, y2 = F.greatest(F.lit(0), F.least(x2, width)), F.greatest(F.lit(0), F.least(y2, height))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def extent_to_yolo(xmin, ymin, xmax, ymax, place_x, place_y, width, height) -> Column:
    """A mask's extent, moved to its place, as a normalised box; null if it lies outside."""
    width, height = c(width), c(height)
    x1, y1 = F.greatest(F.lit(0), c(xmin) + c(place_x)), F.greatest(F.lit(0), c(ymin) + c(place_y))
    x2, y2 = F.least(width, c(xmax) + 1 + c(place_x)), F.least(height, c(ymax) + 1 + c(place_y))
    made = F.struct(((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"))
    return F.when((x2 > x1) & (y2 > y1), made)


def unletterbox(cx, cy, w, h, ratio, pad_x, pad_y, width, height) -> Box:
    """From letterboxed pixels back to the image, clipped to it."""
    cx, cy, w, h, ratio, pad_x, pad_y, width, height = map(c, (cx, cy, w, h, ratio, pad_x, pad_y, width, height))
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    return (
        clip((cx - w / 2 - pad_x) / ratio, width), clip((cy - h / 2 - pad_y) / ratio, height),
        clip((cx + w / 2 - pad_x) / ratio, width), clip((cy + h / 2 - pad_y) / ratio, height),
    )


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is empty."""
    inter = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_diagnostics(df: DataFrame, width="width", height="height") -> DataFrame:
    """Area, width and height ratios (4 decimals), and whether the box comes within a pixel of an edge."""
    x1, y1, x2, y2 = box_cols()
    w, h, width, height = x2 - x1, y2 - y1, c(width), c(height)
    safe = lambda x, y: F.when(y > 0, F.round(x / y, 4)).otherwise(F.lit(0.0))
    return df.withColumns({
        "area_ratio": safe(w * h, width * height), "width_ratio": safe(w, width), "height_ratio": safe(h, height),
        "touches_border": (x1 <= 1) | (y1 <= 1) | (x2 >= width - 1) | (y2 >= height - 1),
    })


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def box_valid(box: Box, strict: bool) -> Column:
    """All corners finite, and x2 > x1 (strict) or x2 >= x1, and so for y."""
    x1, y1, x2, y2 = (v.cast("double") for v in box)
    order = (x2 > x1) & (y2 > y1) if strict else (x2 >= x1) & (y2 >= y1)
    return F.coalesce(finite(x1) & finite(y1) & finite(x2) & finite(y2) & order, F.lit(False))


def safe_double(v) -> Column:
    """A number from text, null if it is none or not finite."""
    d = c(v).try_cast("double")
    return F.when(finite(d), d)


def safe_int(v, default: int = 0) -> Column:
    return F.coalesce(safe_double(v).cast("int"), F.lit(default))


def base_name(v) -> Column:
    return F.element_at(F.split(F.regexp_replace(c(v), r"\\", "/"), "/"), -1)


def norm_path(v) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c(v), r"\\", "/"), "/+", "/"))


def stem(v) -> Column:
    return F.regexp_replace(base_name(v), r"\.[^.]*$", "")


def object_key(path, box: Box) -> Column:
    """``path|x1,y1,x2,y2`` with four decimals."""
    return F.concat(c(path), F.lit("|"), F.format_string("%.4f,%.4f,%.4f,%.4f", *(v.cast("double") for v in box)))


def with_class_name(df: DataFrame, classes: DataFrame, id_col: str = "class_id", out: str = "class_name") -> DataFrame:
    """Names from the class dimension (a row for each class of the model); unknown ids become class_<id>."""
    known = classes.select(F.col("class_id").alias("_id"), F.col("class_name").alias("_name"))
    named = df.join(F.broadcast(known), F.col(id_col) == F.col("_id"), "left")
    return named.withColumn(out, F.coalesce("_name", F.concat(F.lit("class_"), F.col(id_col).cast("string")))).drop("_id", "_name")


def filter_confidence(df: DataFrame, least: float, per_class: dict[int, float] | None = None) -> DataFrame:
    """Confidence of at least the class's threshold, or the global one."""
    if not per_class:
        return df.where(F.col("confidence") >= least)
    own = F.create_map(*[F.lit(x) for kv in per_class.items() for x in kv])
    return df.where(F.col("confidence") >= F.coalesce(F.try_element_at(own, F.col("class_id")), F.lit(least)))


def images_with_class(annotations: DataFrame, ids: Sequence[int]) -> DataFrame:
    return annotations.where(F.col("class_id").isin(list(ids))).select("image_id").distinct()


def area_bucket(ratio: Column, small: float = 0.05, medium: float = 0.20) -> Column:
    return F.when(ratio < small, "small").when(ratio < medium, "medium").otherwise("large")


def generation_count(ratio: Column, counts: tuple[int, int, int] = (3, 2, 1), small: float = 0.05, medium: float = 0.20) -> Column:
    return F.when(ratio < small, counts[0]).when(ratio < medium, counts[1]).otherwise(counts[2])


def performance_level(ap) -> Column:
    return F.when(c(ap) > 0.9, "good").when(c(ap) > 0.8, "medium").otherwise("poor")


#: Advice for a low recall, a low precision, another cause of a low AP, and for a good class.
RECOMMENDATIONS = (
    "Add more training samples for this class",
    "Reduce false positives by adjusting confidence threshold",
    "Consider data augmentation specific to this class",
    "Performance is good, no specific recommendation",
)


def recommendation(ap, precision, recall) -> Column:
    """What to do about a class."""
    recall_text, precision_text, other_text, good_text = RECOMMENDATIONS
    advice = F.when(c(recall) < 0.8, recall_text).when(c(precision) < 0.8, precision_text).otherwise(other_text)
    return F.when(c(ap) < 0.85, advice).otherwise(good_text)


def confusion_kind(mean_iou, hi: float = 0.8, lo: float = 0.5) -> Column:
    v = c(mean_iou)
    return F.when(v.isNull(), "unknown").when(v >= hi, "classification_dominant").when(v < lo, "localization_dominant").otherwise("mixed")


def size_ok(width, height, least_side: int = 10, least_aspect: float = 0.0, most_aspect: float = 1e9) -> Column:
    w, h = c(width), c(height)
    aspect = F.when(h > 0, w / h)
    return F.coalesce((w >= least_side) & (h >= least_side) & aspect.between(least_aspect, most_aspect), F.lit(False))


def train_only(df: DataFrame, train_root: str, path: str = "path") -> DataFrame:
    """Rows of the training split below the training root; nothing of another split ever passes."""
    root = F.lit(train_root.rstrip("/").lower() + "/")
    return df.where((F.col("split") == "train") & F.startswith(norm_path(path), root))
