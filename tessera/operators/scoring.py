"""Batch scoring with a pluggable model, and decoding of raw scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.boxes import box_diagnostics, unletterbox
from tessera.operators.matching import nms, suppressed

#: Where the image lies in its square: ``whole`` counts the pixels left of and above it, ``half`` half of the whole padding,
#: which an odd padding makes one half more than the pixels that are there.  The pixels themselves are the same.
PADDINGS = ("whole", "half")
Model = Callable[[np.ndarray], "list[np.ndarray] | np.ndarray"]


def _linear(n: int, m: int) -> np.ndarray:
    """Weights that take m samples from n by linear interpolation between the middles of pixels; borders repeat."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    part = at - low
    out = np.zeros((m, n))
    out[np.arange(m), low] = 1 - part
    out[np.arange(m), np.minimum(low + 1, n - 1)] += part
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling of pixels (height, width, channels), rounded to bytes; two matrix products for all channels."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image
    out = np.einsum("yi,ijc,xj->yxc", _linear(h, height), image.astype(float), _linear(w, width), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def letterbox(image: np.ndarray, size: int = 640, grey: int = 114, padding: str = "whole") -> tuple[np.ndarray, float, float, float]:
    """The image inside a square of ``size``, its ratio, and the padding left and above by ``padding`` (of PADDINGS)."""
    if padding not in PADDINGS:
        raise ValueError(f"padding must be one of {PADDINGS}")
    h, w = image.shape[:2]
    ratio = min(size / h, size / w)
    nh, nw = max(1, round(h * ratio)), max(1, round(w * ratio))
    top, left = (size - nh) // 2, (size - nw) // 2
    out = np.full((size, size, image.shape[2]), grey, np.uint8)
    out[top : top + nh, left : left + nw] = resize(image, nh, nw)
    return out, ratio, *((float(left), float(top)) if padding == "whole" else ((size - nw) / 2, (size - nh) / 2))


def to_tensor(image: np.ndarray) -> np.ndarray:
    """BGR pixels (or grey ones) as an RGB tensor, channels first, in [0, 1]."""
    rgb = image[:, :, 2::-1] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    return np.ascontiguousarray(rgb.transpose(2, 0, 1)).astype(np.float32) / 255


def _images(data: np.ndarray, height: np.ndarray, width: np.ndarray) -> list[np.ndarray | None]:
    """The images of a batch; None where there are no pixels, or not as many as their size needs."""
    made = []
    for d, h, w in zip(data, height, width, strict=True):
        pixels = None if d is None else np.frombuffer(d, np.uint8)
        whole = pixels is not None and h > 0 and w > 0 and len(pixels) > 0 and len(pixels) % (int(h) * int(w)) == 0
        made.append(pixels.reshape(int(h), int(w), -1) if whole else None)
    return made


def _batched(load_model: Callable[[], Model], prepare: Callable, finish: Callable, returns: T.StructType, batch: int):
    """A column function of (data, height, width): images are prepared, go to the model all at once, and each result is finished."""

    def make():
        model = load_model()

        def predict(data: np.ndarray, height: np.ndarray, width: np.ndarray) -> list[dict]:
            images = _images(data, height, width)
            at = [i for i, x in enumerate(images) if x is not None]
            ready = [prepare(images[i]) for i in at]
            found = model(np.stack([r[0] for r in ready])) if ready else []
            if len(found) != len(ready):
                raise ValueError(f"the model gave {len(found)} results for {len(ready)} images")
            out = [finish(None, None, None)] * len(images)
            for i, r, f in zip(at, ready, found, strict=True):
                out[i] = finish(np.asarray(f, float), r, images[i].shape)
            return out

        return predict

    # Not deterministic to Spark: else each use of the column would be a call of its own.
    udf = predict_batch_udf(make, return_type=returns, batch_size=batch).asNondeterministic()
    return udf("data", F.coalesce("height", F.lit(-1)).alias("height"), F.coalesce("width", F.lit(-1)).alias("width"))


def score(images: DataFrame, load_model: Callable[[], Model], conf: float = 0.25, size: int = 640, batch: int = 16, padding: str = "whole") -> DataFrame:
    """Detections of images (image_id, height, width, data) with a confidence of ``conf`` or more.

    ``load_model`` runs once in each worker and returns a function from a batch of tensors (n, 3, size, size) to n arrays
    of rows (cx, cy, w, h, confidence, class) in letterboxed pixels; it is called once for ``batch`` images.  Images
    without pixels have no detections.  The threshold goes to the scan of the scores, as no filter reaches into Python.
    """

    def prepare(image: np.ndarray) -> tuple:
        boxed, *how = letterbox(image, size, padding=padding)
        return to_tensor(boxed), *how

    def finish(found: np.ndarray | None, how: tuple | None, shape: tuple | None) -> dict:
        if found is None:
            return {"found": np.zeros(0)}
        _, ratio, left, top = how
        found = found.reshape(-1, 6)
        cx, cy, w, h, c, k = found[found[:, 4] >= conf].T
        corners = ((cx - w / 2 - left, 1), (cy - h / 2 - top, 0), (cx + w / 2 - left, 1), (cy + h / 2 - top, 0))
        return {"found": np.stack([k, c, *(np.clip(v / ratio, 0, shape[axis]) for v, axis in corners)], axis=1).ravel()}

    column = _batched(load_model, prepare, finish, T.StructType([T.StructField("found", T.ArrayType(T.DoubleType()))]), batch)
    scored = images.select(F.col("image_id").cast("string").alias("image_id"), column.alias("s")).where(F.size("s.found") > 0)
    names = ("class_id", "confidence", "x1", "y1", "x2", "y2")
    each = F.expr("transform(sequence(0, size(s.found) div 6 - 1), i -> struct(i AS pred_idx, " + ", ".join(f"s.found[6 * i + {j}] AS {n}" for j, n in enumerate(names)) + "))")
    return scored.select("image_id", F.explode(each).alias("d")).select("image_id", "d.pred_idx", F.col("d.class_id").cast("int").alias("class_id"), *[f"d.{n}" for n in names[1:]])


def embed(images: DataFrame, load_model: Callable[[], Model], size: int = 224, batch: int = 16) -> DataFrame:
    """object_id and unit vector of each crop (object_id, height, width, data); failures have a null vector.

    The model gets batches of tensors (n, 3, size, size) and returns n vectors.
    """

    def finish(v: np.ndarray | None, how: tuple | None, shape: tuple | None) -> dict:
        n = 0 if v is None else np.linalg.norm(v)
        return {"embedding": v.ravel() / n if n and np.isfinite(n) else np.zeros(0)}

    column = _batched(load_model, lambda x: (to_tensor(resize(x, size, size)),), finish, T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType()))]), batch)
    made = images.select(F.col("object_id").cast("string").alias("object_id"), column.alias("s"))
    return made.select("object_id", F.when(F.size("s.embedding") > 0, F.col("s.embedding")).alias("embedding"))


def raw_scores(frames: DataFrame, load_model: Callable[[], Model], conf: float = 0.25, size: int = 640, batch: int = 16, padding: str = "whole") -> DataFrame:
    """The columns of ``frames`` (height, width, data among them) and raw: rows, ratio, pad_x, pad_y, as ``decode_frames`` takes them.

    The model gives, for each image, rows of (cx, cy, w, h, a score for each class); those whose best score is below
    ``conf`` are left out where they arise.
    """

    def prepare(image: np.ndarray) -> tuple:
        boxed, *how = letterbox(image, size, padding=padding)
        return to_tensor(boxed), *how

    def finish(found: np.ndarray | None, how: tuple | None, shape: tuple | None) -> dict:
        if found is None or not len(found):
            return {"values": np.zeros(0), "width": 0, "ratio": 1.0, "pad_x": 0.0, "pad_y": 0.0}
        at = np.flatnonzero(found[:, 4:].max(1) >= conf)
        return {"values": np.column_stack([at, found[at]]).ravel(), "width": found.shape[1] + 1, "ratio": float(how[1]), "pad_x": float(how[2]), "pad_y": float(how[3])}

    fields = [T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("width", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("ratio", "pad_x", "pad_y")]]
    scored = frames.withColumn("_s", _batched(load_model, prepare, finish, T.StructType(fields), batch))
    row = "struct(CAST(_s.values[i * _s.width] AS INT) AS pred_idx, " + ", ".join(f"_s.values[i * _s.width + {j}] AS {n}" for j, n in enumerate(("cx", "cy", "w", "h"), 1)) + ", slice(_s.values, i * _s.width + 6, _s.width - 5) AS scores)"
    rows = F.expr(f"transform(CASE WHEN size(_s.values) > 0 THEN sequence(0, size(_s.values) div _s.width - 1) ELSE slice(sequence(0, 0), 1, 0) END, i -> {row})")
    return scored.withColumn("raw", F.struct(rows.alias("rows"), "_s.ratio", "_s.pad_x", "_s.pad_y")).drop("_s")


def _best(r: Callable[[str], Column], raw: Callable[[str], Column]) -> dict[str, Column]:
    """Confidence, class and box in the image of a raw row."""
    top = F.array_max(r("scores"))
    x1, y1, x2, y2 = unletterbox(r("cx"), r("cy"), r("w"), r("h"), raw("ratio"), raw("pad_x"), raw("pad_y"), F.col("width"), F.col("height"))
    return {"class_id": F.array_position(r("scores"), top).cast("int") - 1, "confidence": top, "x1": x1, "y1": y1, "x2": x2, "y2": y2}


def decode(raw: DataFrame, conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """Detections from raw rows (image_id, pred_idx, cx, cy, w, h, scores, ratio, pad_x, pad_y, width, height).

    Best class, threshold, back to the image, class-agnostic suppression, diagnostics.
    """
    made = raw.select("image_id", "pred_idx", *[v.alias(n) for n, v in _best(F.col, F.col).items()], "width", "height")
    return box_diagnostics(nms(made.where(F.col("confidence") >= conf), iou))


def decode_frames(frames: DataFrame, conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """``decode`` for frames that hold their raw rows (image_id, width, height, raw), inside each row: no shuffle, so a stream can append its result."""

    def one(r: Column) -> Column:
        found = _best(lambda n: r[n], lambda n: F.col("raw")[n])
        return F.struct((-found["confidence"]).alias("_o0"), r["pred_idx"].alias("_o1"), r["pred_idx"].alias("pred_idx"), *[v.alias(n) for n, v in found.items()])

    sure = F.array_sort(F.filter(F.transform(F.col("raw")["rows"], one), lambda x: x["confidence"] >= conf))
    kept = frames.withColumn("c", sure).select("image_id", F.explode(suppressed("c", iou)).alias("m"), "width", "height")
    return box_diagnostics(kept.select("image_id", *[f"m.{n}" for n in ("pred_idx", "class_id", "confidence", "x1", "y1", "x2", "y2")], "width", "height"))


def score_frames(frames: DataFrame, load_model: Callable, conf: float = 0.25) -> DataFrame:
    """frame and its predictions (an empty list where there are none), to be read in order of frame."""
    found = score(frames.withColumn("image_id", F.col("frame").cast("string")), load_model, conf)
    grouped = found.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pred_idx", "class_id", "confidence", "x1", "y1", "x2", "y2"))).alias("predictions"))
    joined = frames.select("frame", F.col("frame").cast("string").alias("image_id")).join(grouped, "image_id", "left")
    return joined.select("frame", F.coalesce("predictions", F.array().cast(grouped.schema["predictions"].dataType)).alias("predictions"))
