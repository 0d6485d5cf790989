"""Latency statistics, speed-ups and agreement of runtimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import finite
from tessera.operators.prefix import percentiles


def check_timings(timings: DataFrame) -> DataFrame:
    """The rows that statistics reject: null, negative or non-finite times."""
    return timings.where(~F.coalesce(finite(F.col("ms")) & (F.col("ms") >= 0), F.lit(False)))


def latency_stats(timings: DataFrame, by: Sequence[str] = ("runtime",), ms: str = "ms", strict: bool = False) -> DataFrame:
    """n, mean, median, population deviation, min, max, linear 95th percentile and frames a second.

    Percentiles are exact and ranked in ranges of the distinct times.  With ``strict`` a bad time fails the job; otherwise bad times are left out.
    """
    v = F.col(ms)
    good = F.coalesce(finite(v) & (v >= 0), F.lit(False))
    if strict:
        timings = timings.withColumn(ms, F.when(good, v).otherwise(F.raise_error(F.lit("a time is negative or not finite"))))
    mean = F.avg(v)
    kept = timings.where(good).withColumn("_key", F.struct(*by))
    plain = kept.groupBy("_key").agg(
        F.count("*").alias("n"), mean.alias("mean_ms"), F.stddev_pop(v).alias("std_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"),
        F.when(mean > 0, 1000 / mean).otherwise(F.lit(0.0)).alias("fps"),
    )
    ranked = percentiles(kept, v, {"median_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed("_key", "_key2")
    both = plain.join(ranked, F.col("_key").eqNullSafe(F.col("_key2")))
    return both.select("_key.*", "n", "mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p95_ms", "fps")


def latency_two_stage(timings: DataFrame) -> DataFrame:
    """Statistics over the images' mean times."""
    good = timings.where(F.coalesce(finite(F.col("ms")) & (F.col("ms") >= 0), F.lit(False)))
    return latency_stats(good.groupBy("runtime", "image").agg(F.avg("ms").alias("ms")))


def speedups(stats: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """baseline mean / comparison mean for pairs of runtimes, 0 where one is missing or not positive."""
    wanted = stats.sparkSession.createDataFrame(list(pairs), "baseline string, comparison string")
    small = stats.select("runtime", "mean_ms")  # a row for each runtime
    a = small.select(F.col("runtime").alias("baseline"), F.col("mean_ms").alias("a"))
    b = small.select(F.col("runtime").alias("comparison"), F.col("mean_ms").alias("b"))
    both = wanted.join(a, "baseline", "left").join(b, "comparison", "left")
    return both.select("baseline", "comparison", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") / F.col("b")).otherwise(F.lit(0.0)).alias("speedup"))


def agreement_by_image(matches: DataFrame, a: DataFrame, b: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per image: predictions of both runtimes, matches, unmatched ones, and the means of IoU and difference of confidence.

    ``images`` (image_id) are those that were compared; one without predictions on either side agrees exactly.  Without
    it, images are those that a prediction names.  *exact*: both sides have as many predictions as matches;
    *near_perfect*: there is a match, and the image's means are at least 0.999 and at most 1e-5.
    """
    n_a = a.groupBy("image_id").agg(F.count("*").alias("n_a"))
    n_b = b.groupBy("image_id").agg(F.count("*").alias("n_b"))
    m = matches.groupBy("image_id").agg(F.count("*").alias("n_match"), F.avg("iou").alias("mean_iou"), F.avg(F.abs(F.col("a_conf") - F.col("b_conf"))).alias("mean_diff"))
    named = n_a.join(n_b, "image_id", "full_outer")
    if images is not None:
        named = images.select("image_id").distinct().join(named, "image_id", "left")
    joined = named.join(m, "image_id", "left").fillna(0, ["n_a", "n_b", "n_match"])
    n = F.col("n_match")
    return joined.withColumns({
        "unmatched_a": F.col("n_a") - n, "unmatched_b": F.col("n_b") - n, "exact": (F.col("n_a") == n) & (F.col("n_b") == n),
        "near_perfect": (n > 0) & F.coalesce((F.col("mean_iou") >= 0.999) & (F.col("mean_diff") <= 1e-5), F.lit(False)),
    })


def agreement_summary(matches: DataFrame, a: DataFrame, b: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Totals over images: rates of exact and nearly perfect ones, and of matches among all detections of both runtimes.

    The match rate divides by matches and both sides' unmatched detections (1 if there are none).  IoU and difference of
    confidence are summed up over the means of the images that have matches: their average is 0 without any, their
    lowest and largest are null.
    """
    n, left_a, left_b = F.sum("n_match"), F.sum("unmatched_a"), F.sum("unmatched_b")
    every = n + left_a + left_b
    rate = lambda v: F.when(F.count("*") > 0, F.count_if(v) / F.count("*"))
    return agreement_by_image(matches, a, b, images).agg(
        F.count("*").alias("n_images"), F.count_if("exact").alias("exact_images"), F.count_if("near_perfect").alias("near_perfect_images"),
        rate("exact").alias("exact_rate"), rate("near_perfect").alias("near_perfect_rate"), F.sum("n_a").alias("total_a"), F.sum("n_b").alias("total_b"),
        (F.sum("n_b") - F.sum("n_a")).alias("count_difference"), n.alias("total_matches"), left_a.alias("unmatched_a"), left_b.alias("unmatched_b"),
        F.when(every > 0, n / every).otherwise(F.lit(1.0)).alias("match_rate"), F.coalesce(F.avg("mean_iou"), F.lit(0.0)).alias("avg_iou"), F.min("mean_iou").alias("min_iou"),
        F.coalesce(F.avg("mean_diff"), F.lit(0.0)).alias("avg_conf_diff"), F.max("mean_diff").alias("max_conf_diff"),
    )


def array_agreement(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Of each row's two arrays: equal length, largest and mean difference, mean relative error (of at least 1e-8)."""
    x, y = F.col(a), F.col(b)
    same = F.size(x) == F.size(y)
    diffs = F.zip_with(x, y, lambda p, q: F.abs(p - q))
    relative = F.zip_with(x, y, lambda p, q: F.abs(p - q) / F.greatest(F.abs(p), F.lit(1e-8)))
    mean = lambda v: F.when(same & (F.size(v) > 0), F.aggregate(v, F.lit(0.0), lambda s, t: s + t) / F.size(v))
    return df.withColumns({"same_shape": same, "max_abs_diff": F.when(same, F.array_max(diffs)), "mean_abs_diff": mean(diffs), "mean_rel_error": mean(relative)})


def scoring_counts() -> dict[str, Column]:
    """What is counted of scored images (inference_ms)."""
    n, total = F.count(F.lit(1)), F.sum("inference_ms")
    return {"n_images": n, "total_ms": total, "avg_ms": F.avg("inference_ms"), "fps": F.when(total > 0, 1000 * n / total).otherwise(F.lit(0.0))}


def scoring_summary(df: DataFrame) -> DataFrame:
    return df.agg(*[v.alias(n) for n, v in scoring_counts().items()])


def _pick(df: DataFrame, names: Sequence[str]) -> Column:
    known = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast("double")


def normalise_benchmark(df: DataFrame) -> DataFrame:
    """runtime, ms, fps from either of the two result layouts; a missing fps follows from ms."""
    ms = _pick(df, ["mean_ms", "avg_inference_ms", "ms"])
    return df.select("runtime", ms.alias("ms"), F.coalesce(_pick(df, ["fps", "avg_fps"]), F.when(ms > 0, 1000 / ms)).alias("fps"))


#: The runtimes and devices that a benchmark file can have results for.
RUNTIMES, DEVICES = ("pytorch", "onnx"), ("cpu", "gpu")


def parse_benchmarks(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of ``files`` but the JSON text, and runtime, ms, fps: a row for each runtime and device that a file has results for.

    Two layouts are read: ``results.<runtime>.<device>``, and ``results.<runtime>_<device>``, which counts only where the
    first gives nothing.  A result needs mean_ms; without fps it is 1000 / mean_ms, or 0.  Results whose numbers are no
    numbers are passed over; a file that is no JSON, or has no result at all, fails the job.
    """

    def result(path: str, name: str) -> Column:
        number = lambda k: F.try_variant_get("_v", f"$.results.{path}.{k}", "double")
        given = F.try_variant_get("_v", f"$.results.{path}.fps", "variant")
        fps_given = given.isNotNull() & ~F.coalesce(F.is_variant_null(given), F.lit(False))
        ms = number("mean_ms")
        fps = F.when(fps_given, number("fps")).otherwise(F.when(ms > 0, 1000 / ms).otherwise(F.lit(0.0)))
        return F.when(ms.isNotNull() & fps.isNotNull(), F.struct(F.lit(name).alias("runtime"), ms.alias("ms"), fps.alias("fps")))

    found = lambda join: F.array_compact(F.array(*[result(f"{r}{join}{d}", f"{r}_{d}") for r in RUNTIMES for d in DEVICES]))
    both = files.withColumn("_v", F.parse_json(content)).withColumns({"_nested": found("."), "_flat": found("_")})
    none = F.raise_error(F.lit("no results in a benchmark file")).cast(both.schema["_flat"].dataType)
    rows = F.when(F.size("_nested") > 0, F.col("_nested")).when(F.size("_flat") > 0, F.col("_flat")).otherwise(none)
    rest = [c for c in files.columns if c != content]
    return both.select(*rest, F.explode(rows).alias("r")).select(*rest, "r.*")


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """path, runtime, ms, fps of benchmark files, each a whole JSON text."""
    files = spark.read.format("binaryFile").load(path)
    return parse_benchmarks(files.select("path", F.col("content").cast("string").alias("content")))


def compare_benchmarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of ms and fps for the runtimes that both have; percentages are null from a base of 0."""
    a, b = normalise_benchmark(old), normalise_benchmark(new)
    both = a.select("runtime", F.col("ms").alias("old_ms"), F.col("fps").alias("old_fps")).join(b.select("runtime", F.col("ms").alias("new_ms"), F.col("fps").alias("new_fps")), "runtime")
    out = both
    for x in ("ms", "fps"):
        out = out.withColumn(f"{x}_change", F.col(f"new_{x}") - F.col(f"old_{x}"))
        out = out.withColumn(f"{x}_change_pct", F.when(F.col(f"old_{x}") != 0, 100 * F.col(f"{x}_change") / F.col(f"old_{x}")))
    return out
