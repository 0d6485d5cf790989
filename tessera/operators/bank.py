"""Audits of image banks: quality, duplicates, acceptance in order."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of BGR(A) or grey pixels, as doubles."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return x[:, :, 0] if channels < 3 else x[:, :, 0] * 0.114 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.299


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, borders mirrored."""
    p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray).var())


def area_matrix(n: int, m: int) -> np.ndarray:
    """Weights that shrink n samples to m by the area each covers."""
    edges = np.linspace(0, n, m + 1)
    left, right = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
    return np.clip(np.minimum(right, edges[1:, None]) - np.maximum(left, edges[:-1, None]), 0, None) * m / n


def phash(gray: np.ndarray, bits: int = 8, size: int = 32) -> int:
    """Bits of the low cosine frequencies that exceed their median; both steps are matrix products."""
    small = area_matrix(gray.shape[0], size) @ gray @ area_matrix(gray.shape[1], size).T
    k = np.arange(size)
    dct = np.sqrt(2 / size) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * size))
    dct[0] /= np.sqrt(2)
    low = (dct @ small @ dct.T)[:bits, :bits].ravel()
    value = int("".join("1" if x > np.median(low) else "0" for x in low), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def pixel_facts(images: DataFrame) -> DataFrame:
    """path, width, height and the three raw numbers of quality, and the perceptual hash. Unreadable images: nulls."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.data is None or r.height is None or r.height <= 0 or r.width <= 0:
                    rows.append((r.path, None, None, None, None, None, None))
                    continue
                g = to_gray(r.data, int(r.height), int(r.width), int(r.nChannels))
                rows.append((r.path, int(r.width), int(r.height), laplacian_variance(g), float(g.mean()), float(g.std()), phash(g)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "laplacian", "brightness", "contrast", "perceptual_hash"]).astype({"width": "Int64", "height": "Int64", "perceptual_hash": "Int64"})

    flat = images.select("path", "height", "width", "nChannels", "data")
    return flat.mapInPandas(work, "path string, width int, height int, laplacian double, brightness double, contrast double, perceptual_hash long")


def image_quality(facts: DataFrame) -> DataFrame:
    """Score .5 sharpness + .25 brightness + .25 contrast, and flags."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    blur, light, contrast = F.col("laplacian"), F.col("brightness"), F.col("contrast")
    score = 0.5 * unit(blur / 500) + 0.25 * unit(1 - F.abs(light - 127.5) / 127.5) + 0.25 * unit(contrast / 64)
    return facts.withColumns({"quality_score": score, "is_blurry": blur < 50, "is_dark": light < 35, "is_bright": light > 220, "is_flat": contrast < 25})


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def exact_duplicates(hashed: DataFrame, path: str = "path") -> DataFrame:
    """For each content that occurs more than once: first path and number of copies."""
    return hashed.groupBy("content_hash").agg(F.min(path).alias("first_path"), F.count("*").alias("copies")).where("copies > 1")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in itertools.combinations(range(width), r)]


def class_pairs(hashes: DataFrame, most: int = 8, id_col: str = "path", hash_col: str = "perceptual_hash") -> DataFrame:
    """Pairs (a < b, distance) of the first members of unlike hashes within a distance of ``most``.

    Hashes are cut into (most + 1) / 3 bands, so two within the distance differ by two bits at most in one of them:
    one side is joined on its bands, the other on all masks of two bits.  Wide bands keep what meets by chance small.
    """
    rows = hashes.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    first = rows.groupBy("h").agg(F.min("id").alias("id"))
    n = max(1, (most + 1) // 3)
    edges = [64 * i // n for i in range(n + 1)]
    cut = lambda s, e: F.shiftrightunsigned(F.shiftleft("h", 64 - e), 64 - (e - s))
    plain = F.array(*[F.struct(F.lit(i).alias("band"), cut(s, e).alias("bits")) for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False))])
    masks = [[m for m in _ball(e - s, most // n)] for s, e in zip(edges, edges[1:], strict=False)]
    p = first.select(F.col("id").alias("p"), F.col("h").alias("hp"), F.explode(plain).alias("x")).select("p", "hp", "x.band", "x.bits")
    table = hashes.sparkSession.createDataFrame([(i, m) for i, ms in enumerate(masks) for m in ms], "band int, mask long")  # a few hundred rows
    q = first.select(F.col("id").alias("q"), F.col("h").alias("hq"), F.explode(plain).alias("x")).select("q", "hq", "x.band", "x.bits")
    q = q.join(F.broadcast(table), "band").select("q", "hq", "band", F.col("bits").bitwiseXOR(F.col("mask")).alias("bits"))
    met = p.join(q, ["band", "bits"]).where((F.col("p") < F.col("q")) & (hamming(F.col("hp"), F.col("hq")) <= most))
    return met.select(F.col("p").alias("a"), F.col("q").alias("b"), hamming(F.col("hp"), F.col("hq")).alias("distance")).distinct()


def near_pairs(hashes: DataFrame, most: int = 8, id_col: str = "path", hash_col: str = "perceptual_hash") -> DataFrame:
    """Pairs (a < b, distance) within ``most`` bits: between the first members of unlike hashes, and of each member of a hash with its first."""
    rows = hashes.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    first = rows.groupBy("h").agg(F.min("id").alias("first"))
    same = rows.join(first, "h").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return class_pairs(hashes, most, id_col, hash_col).unionByName(same)


#: Fixed value: the image files that a bank takes.
SUPPORTED = r"\.(jpg|jpeg|png|webp)$"


def validate_images(df: DataFrame, least_width: int = 640, least_height: int = 480, least_aspect: float = 0.5, most_aspect: float = 2.5, least_quality: float = 0.25) -> DataFrame:
    """Reasons against each image, in fixed order; usable if there are none.

    A failure before the pixels is the only reason: an unsupported extension (of the path), an unreadable image (no
    size), sizes that are not positive.  Columns is_found and is_file, if there, tell paths that are not there or no files.
    """
    aspect = F.when(F.col("height") > 0, F.col("width") / F.col("height"))
    codes = [
        F.when(F.col("width") < least_width, "width_too_small"), F.when(F.col("height") < least_height, "height_too_small"), F.when(aspect < least_aspect, "aspect_ratio_too_small"),
        F.when(aspect > most_aspect, "aspect_ratio_too_large"), F.when(F.col("is_blurry"), "image_blurry"), F.when(F.col("is_dark"), "image_too_dark"), F.when(F.col("is_bright"), "image_too_bright"),
        F.when(F.col("is_flat"), "low_contrast"), F.when(F.col("quality_score") < least_quality, "quality_score_too_low"),
    ]
    flag = lambda name: ~F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    early = F.when(flag("is_found"), "file_not_found").when(flag("is_file"), "not_a_file")
    if "path" in df.columns and dict(df.dtypes)["path"] == "string":
        early = early.when(~F.lower("path").rlike(SUPPORTED), "unsupported_extension")
    early = early.when(F.col("width").isNull() | F.col("height").isNull(), "image_unreadable").when((F.col("width") <= 0) | (F.col("height") <= 0), "invalid_dimensions")
    reasons = F.when(early.isNotNull(), F.array(early)).otherwise(F.array_compact(F.array(*codes)))
    return df.withColumn("aspect_ratio", aspect).withColumn("reasons", reasons).withColumn("usable", F.size("reasons") == 0)


def accept_in_order(validated: DataFrame, most: int = 8, id_col: str = "path", hash_col: str = "perceptual_hash", checkpoint=None) -> DataFrame:
    """Accept usable images in order of id, unless an earlier *accepted* one is within ``most`` bits.

    Of equal hashes only the first can be accepted: whatever it meets, the later ones meet too.  So the rounds work
    on one row for each hash: a row without an undecided earlier neighbour is accepted, and later neighbours of
    accepted rows are rejected; rounds are few where order and likeness have nothing to do with each other.  Images
    without a hash are like no other.  ``checkpoint`` cuts the lineage of a DataFrame (default: DataFrame.checkpoint).
    """
    cut_off = checkpoint or cut
    good = validated.where("usable")
    firsts = good.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("id")).select("id")
    pairs = cut_off(class_pairs(good, most, id_col, hash_col).select("a", "b"))
    state = cut_off(firsts.withColumn("accepted", F.lit(None).cast("boolean")))
    while not state.where("accepted IS NULL").isEmpty():
        open_rows = state.where("accepted IS NULL").select("id")
        waiting = pairs.join(open_rows.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = open_rows.join(waiting, "id", "left_anti").select("id", F.lit(True).alias("decision"))
        beaten = pairs.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        decided = new.unionByName(beaten.join(open_rows, "id", "left_semi").select("id", F.lit(False).alias("decision")))
        state = cut_off(state.join(decided, "id", "left").select("id", F.coalesce("accepted", "decision").alias("accepted")))
    ids = good.select(F.col(id_col).alias("id"), F.col(hash_col).isNull().alias("_alone"))
    return ids.join(state, "id", "left").select("id", F.coalesce("accepted", "_alone").alias("accepted"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where it is unset and all runs in one process."""
    import tempfile

    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    return root or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def duplicate_reasons(validated: DataFrame, accepted: DataFrame, most: int = 8, id_col: str = "path", hash_col: str = "perceptual_hash") -> DataFrame:
    """id, reasons: every image (unusable ones too) against earlier accepted ones; an exact copy has both codes.

    Equal hashes are one for the join, so a large group of copies costs a row for each member.
    """
    rows = validated.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    kept = accepted.where("accepted").select("id")
    # Of each hash the first accepted image; unlike hashes meet by the first member of each.
    firsts = rows.groupBy("h").agg(F.min("id").alias("first"))
    owners = rows.join(kept, "id", "left_semi").groupBy("h").agg(F.min("id").alias("owner")).join(firsts, "h")
    pairs = class_pairs(validated, most, id_col, hash_col)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(firsts.select(F.col("first").alias("a"), F.col("first").alias("b")))
    met = owners.select(F.col("first").alias("a"), "owner").join(both, "a").groupBy("b").agg(F.min("owner").alias("owner"))
    near = rows.join(firsts, "h").join(met.withColumnRenamed("b", "first"), "first").where("id > owner").select("id")
    hashes = validated.select(F.col(id_col).alias("id"), "content_hash")
    owner = hashes.join(kept, "id", "left_semi").groupBy("content_hash").agg(F.min("id").alias("owner"))
    exact = hashes.join(owner, "content_hash").where("id > owner").select("id").withColumn("_e", F.lit("exact_duplicate"))
    coded = near.withColumn("_n", F.lit("near_duplicate")).join(exact, "id", "full_outer")
    return coded.select("id", F.array_compact(F.array("_e", "_n")).alias("reasons"))


def bank_summary(validated: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.count_if("usable")
    return validated.agg(n.alias("total"), good.alias("approved"), (n - good).alias("rejected"), F.when(n > 0, good / n).otherwise(F.lit(0.0)).alias("approval_rate"))


def mask_facts(objects: DataFrame) -> DataFrame:
    """From mask and alpha bytes (one byte a pixel): binary, share of white, empty alpha, sizes that agree."""

    @F.pandas_udf("struct<is_binary:boolean,white:double,alpha_empty:boolean,mask_size:int>")
    def facts(mask: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        rows = []
        for m, a in zip(mask, alpha, strict=True):
            m, a = np.frombuffer(m or b"", np.uint8), np.frombuffer(a or b"", np.uint8)
            rows.append((bool(np.isin(m, (0, 255)).all()), float((m == 255).mean()) if len(m) else 0.0, not a.any(), len(m)))
        return pd.DataFrame(rows, columns=["is_binary", "white", "alpha_empty", "mask_size"])

    return objects.withColumn("facts", facts("mask", "alpha"))


def audit_object_bank(objects: DataFrame) -> DataFrame:
    """Problems of each object of a bank (columns of mask_facts, width, height, segmentation_score and manifest fields)."""
    f = F.col("facts")
    needed = ["object_id", "class_id", "class_name", "source_image"]
    codes = [
        F.when(~f["is_binary"], "mask_not_binary"), F.when(f["white"] == 0, "mask_all_black"), F.when(f["white"] == 1, "mask_all_white"), F.when(f["alpha_empty"], "alpha_empty"),
        F.when(f["mask_size"] != F.col("width") * F.col("height"), "size_mismatch"), F.when(~F.coalesce(F.col("segmentation_score").between(0, 1), F.lit(False)), "score_out_of_range"),
        *[F.when(F.col(x).isNull(), F.lit(f"missing_{x}")) for x in needed],
    ]
    return mask_facts(objects).withColumn("problems", F.array_compact(F.array(*codes))).drop("facts")


def background_type(synthetic: DataFrame, originals: DataFrame, least: float = 3.0) -> DataFrame:
    """train or external: mean absolute difference to the original outside the pasted box below ``least`` is train."""

    @F.pandas_udf("double")
    def difference(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series, n: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        out = []
        for p, q, hh, ww, nn, l, t, r, d in zip(a, b, h, w, n, x1, y1, x2, y2, strict=True):
            if p is None or q is None or len(p) != len(q):
                out.append(float("inf"))
                continue
            diff = np.abs(np.frombuffer(p, np.uint8).astype(float) - np.frombuffer(q, np.uint8)).reshape(int(hh), int(ww), int(nn))
            keep = np.ones((int(hh), int(ww)), bool)
            keep[int(t) : int(d), int(l) : int(r)] = False
            out.append(float(diff[keep].mean()) if keep.any() else 0.0)
        return pd.Series(out)

    o = originals.select("stem", F.col("data").alias("_original"))
    joined = synthetic.join(o, "stem", "left")
    diff = difference("data", "_original", "height", "width", "nChannels", "x1", "y1", "x2", "y2")
    return joined.withColumn("difference", diff).withColumn("background", F.when(F.col("difference") < least, "train").otherwise("external")).drop("_original")

